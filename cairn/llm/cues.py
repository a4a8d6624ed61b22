"""Texts of numbered, timed cues: repair of encodings, cutting into cues, and which cues hold no language."""

from __future__ import annotations

import re
import unicodedata

#: A cue's head: perhaps a number on a line of its own, then the line of times.
HEAD = re.compile(r"(?:^|\n)[ \t]*(?:\d+[ \t]*\n[ \t]*)?\d[\d:.,; \t]*-+>[^\n]*(?=\n|$)")
MARKUP = re.compile(r"<[^<>\n]{0,80}>|\{[^{}\n]{0,80}\}|&[a-z]{2,6};")
SOUND = re.compile(r"\[[^\[\]]{0,120}\]|\([^()]{0,120}\)|\*[^*\n]{1,120}\*")
SPEAKER = re.compile(r"(?m)^[ \t]*(?:[-–—][ \t]*)?\w[\w .'-]{0,24}:(?=\s)")
MUSIC = re.compile(r"[♪♫♩♬]")
#: Marks of adverts and credits, which are often in another language than the text.
ADVERT = re.compile(
    r"www\.|https?:|\.(?:com|org|net|example|info|tv)\b|@\w|===|\bsubtitles?\b|\bsubbed by\b|\bsynced\b|\bcorrected by\b|\brip by\b"
    r"|\bjoin our\b|\bvip member\b|\badvertise your\b|\bteam \d+"
)
#: Characters without meaning for the language (soft hyphen, zero width, direction marks, byte order mark).
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060\ufe0f\ufeff]")
#: A cue without any of these is no advert (the quick test before the pattern).
ADVERT_MARKS = ("www", "http", ".com", ".org", ".net", ".example", ".info", ".tv", "@", "===", "subtitle", "subbed", "synced", "corrected", "rip by", "join our", "vip member", "advertise", "team ")
WORD = re.compile(r"[^\W\d_]+")
#: Interjections that no language owns; a cue of nothing else has no language.
INTERJECTIONS = frozenset("ah aah aaah ach aha ahh eh ehh ha haha hah he heh hehe hey hi ho hm hmm hmmm hum mm mmm mmmm o oh ohh oho ooh oooh ouch ow psst pst sh shh shhh uh uhh uhm um ugh wow yeah а ах эх ох ага ха хм м мм ммм о ой у ух".split())


def _single_bytes() -> dict[int, int]:
    """The byte that a character stands for in a text read as Latin-1 or Windows-1252."""
    out = {c: c for c in range(256)}
    for b in range(128, 160):
        try:
            out[ord(bytes([b]).decode("cp1252"))] = b
        except UnicodeDecodeError:
            pass
    return out


BYTE_OF = _single_bytes()
_CONTINUED = "".join(chr(c) for c, b in BYTE_OF.items() if 0x80 <= b < 0xC0)
MISREAD = re.compile(f"(?:[Â-ß][{re.escape(_CONTINUED)}]|[à-ï][{re.escape(_CONTINUED)}]{{2}}|[ð-ô][{re.escape(_CONTINUED)}]{{3}})+")
SUSPECT = re.compile(f"[Â-ô][{re.escape(_CONTINUED)}]")
#: A word of Latin letters with marks only: Windows-1251 read as Latin-1.
MISREAD_CYRILLIC = re.compile(r"[À-ÿ¨¸]{4,}")
CYRILLIC = {b: ord(bytes([b]).decode("cp1251")) for b in (0xA8, 0xB8, *range(0xC0, 0x100))}


def _reread(match: re.Match) -> str:
    try:
        return bytes(BYTE_OF[ord(c)] for c in match.group()).decode("utf-8")
    except UnicodeDecodeError:
        return match.group()


def repair(text: str) -> str:
    """Undo UTF-8 that was read as Latin-1 or Windows-1252 (also twice) and Windows-1251 read as Latin-1, line by line;
    then NFC, without invisible characters."""
    if text.isascii():
        return text
    for _ in range(2):
        if SUSPECT.search(text):
            text = MISREAD.sub(_reread, text)
    if INVISIBLE.search(text):
        text = INVISIBLE.sub("", text)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if MISREAD_CYRILLIC.search(text):
        text = "\n".join(line.translate(CYRILLIC) if MISREAD_CYRILLIC.search(line) else line for line in text.split("\n"))
    return text


def cue_words(text: str) -> list[list[str]]:
    """The lower-case words of each cue, in text order, without markup, sound descriptions and speakers; none for a cue
    that is an advert or holds interjections only. Numbers, times and blank lines are not needed to be right: a cue begins at its line of times."""
    text = repair(text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n"))
    cues = HEAD.split(MARKUP.sub("", text))[1:]
    low = text.lower()
    doubtful = any(x in low for x in ADVERT_MARKS)
    out = []
    for cue in cues:
        if "[" in cue or "(" in cue or "*" in cue:
            cue = SOUND.sub(" ", cue)
        if ":" in cue:
            cue = SPEAKER.sub(" ", cue)
        cue = cue.lower()
        if doubtful and any(x in cue for x in ADVERT_MARKS) and ADVERT.search(cue):
            out.append([])
        else:
            words = WORD.findall(cue)
            out.append([] if INTERJECTIONS.issuperset(words) else words)
    return out
