"""Has this key been seen before? Ribbon filters over sealed batches.

A ribbon filter of n keys is the solution Z of a banded system over GF(2): key k has a start s(k), a band of 64
coefficients c(k) that begins with a one, and a fingerprint f(k) of r bits; the rows c(k) . Z[s .. s+63] = f(k) are made
triangular and solved backwards. A stored key always answers yes; another one with probability 2^-r. The keys of a filter
are spread over blocks of a few thousand, each a system of its own, so that all of them are solved in step.

A generation is a batch. When it is sealed, its distinct keys become one filter a shard (a range of key hashes) and a
sorted run of records, written once to the store's folder and never changed by later batches. A key is probed with the
filters of the generations before its own, oldest first: where all say no it is new, for certain. A yes names the one
generation whose record is looked up, in the row groups that can hold the key; only if it isn't there do the later
filters speak. Tasks hold the filters of one shard (about 1.2 r bits a key), never the keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.hashes import hash_bytes
from cairn.llm import runs
from cairn.llm.runs import Part, Places, Reader
from cairn.session import checkpoint_dir, cut

WIDTH = 64
#: Keys of a block on average, and slots beyond the keys of the fullest block.
BLOCK, OVERHEAD = 2048, 0.12
#: Bits of a fingerprint; bits of a key's hash that name its shard.
BITS, SHARD_BITS = 12, 4
BASE = -1
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit finaliser of splitmix64."""
    x = x ^ (np.uint64(seed * _GOLDEN % 2**64) if isinstance(seed, int) else seed.astype(np.uint64) * np.uint64(_GOLDEN))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _share(h: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """The upper half of a hash as a number below `parts`."""
    return ((h >> np.uint64(32)) * np.asarray(parts, np.uint64)) >> np.uint64(32)


@dataclass
class Ribbon:
    """A sealed filter: `bits` columns of blocks of `slots` solution bits, packed into words."""

    slots: int  # of a block, a multiple of WIDTH
    bits: int
    seeds: np.ndarray  # of each block
    words: np.ndarray  # (bits, blocks * slots / 64 + 1) of uint64

    def equations(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, band, fingerprint) of each key."""
        block = _share(mix(keys, 5), len(self.seeds))
        h = mix(keys, 7 + self.seeds[block.astype(np.int64)].astype(np.uint64))
        band = mix(h, 2) | np.uint64(1)
        return block * np.uint64(self.slots) + _share(h, self.slots - WIDTH + 1), band, mix(band, 77) >> np.uint64(64 - self.bits)

    @classmethod
    def build(cls, keys: np.ndarray, bits: int = BITS) -> Ribbon:
        """A filter of distinct 64-bit keys. A block whose system fails gets another seed, and after eight of them all
        blocks get more slots."""
        blocks = max(1, round(len(keys) / BLOCK))
        block = _share(mix(keys, 5), blocks).astype(np.int64)
        fullest, grown = int(np.bincount(block, minlength=blocks).max()), 0.0
        while True:
            slots = WIDTH * (2 + int(fullest * (1 + OVERHEAD + grown)) // WIDTH)
            made = cls(slots, bits, np.zeros(blocks, np.uint8), np.zeros((bits, blocks * slots // WIDTH + 1), np.uint64))
            bands, values = np.zeros(blocks * slots, np.uint64), np.zeros(blocks * slots, np.uint64)
            todo = np.ones(blocks, bool)
            for _ in range(8):
                mine = todo[block]
                bands.reshape(blocks, slots)[todo] = 0
                values.reshape(blocks, slots)[todo] = 0
                todo = cls._eliminate(*made.equations(keys[mine]), bands, values, slots, blocks)
                if not todo.any():
                    made._back(bands, values)
                    return made
                made.seeds[todo] += 1
            grown += 0.1

    @staticmethod
    def _eliminate(start: np.ndarray, band: np.ndarray, value: np.ndarray, bands: np.ndarray, values: np.ndarray, slots: int, blocks: int) -> np.ndarray:
        """Make the rows triangular in place, all pending rows at once: a row takes a free slot, or is reduced by the one
        that has it and moves on. Which blocks failed."""
        failed, owner = np.zeros(blocks, bool), np.zeros(len(bands), np.int64)
        start = start.astype(np.int64)
        while len(start):
            free = np.flatnonzero(bands[start] == 0)
            owner[start[free]] = free
            first = free[owner[start[free]] == free]
            bands[start[first]], values[start[first]] = band[first], value[first]
            left = np.ones(len(start), bool)
            left[first] = False
            start, band, value = start[left], band[left], value[left]
            band, value = band ^ bands[start], value ^ values[start]
            gone = band == 0
            failed[start[gone & (value != 0)] // slots] = True
            start, band, value = start[~gone], band[~gone], value[~gone]
            shift = np.bitwise_count((band & (~band + np.uint64(1))) - np.uint64(1))
            start, band = start + shift, band >> shift.astype(np.uint64)
        return failed

    def _back(self, bands: np.ndarray, values: np.ndarray) -> None:
        """Solve from the last slot to the first, all blocks and columns in step."""
        blocks, m = len(self.seeds), self.slots
        bands, window = bands.reshape(blocks, m), np.zeros((blocks, self.bits), np.uint64)
        wanted = (values.reshape(blocks, m, 1) >> np.arange(self.bits, dtype=np.uint64)) & np.uint64(1)
        one = np.uint64(1)
        out = self.words[:, :-1].reshape(self.bits, blocks, m // WIDTH)
        for i in range(m - 1, -1, -1):
            window <<= one
            window |= (np.bitwise_count(window & bands[:, i, None]) & 1) ^ wanted[:, i]
            if not i % WIDTH:
                out[:, :, i // WIDTH] = window.T

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be stored. Column by column; a key that one refuses is not asked further."""
        hit = np.ones(len(keys), bool)
        start, band, want = self.equations(keys)
        word, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        back, left = np.uint64(63) - shift, np.arange(len(keys))
        for k in range(self.bits):
            row = self.words[k]
            window = (row[word] >> shift) | ((row[word + 1] << np.uint64(1)) << back)
            good = (np.bitwise_count(window & band) & 1) == ((want >> np.uint64(k)) & np.uint64(1))
            hit[left[~good]] = False
            left, word, shift, back, band, want = (x[good] for x in (left, word, shift, back, band, want))
        return hit

    def pack(self) -> bytes:
        return np.array([self.slots, self.bits, len(self.seeds)], dtype=np.int64).tobytes() + self.words.tobytes() + self.seeds.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Ribbon:
        slots, bits, blocks = np.frombuffer(data[:24], dtype=np.int64).tolist()
        size = bits * (blocks * slots // WIDTH + 1)
        words = np.frombuffer(data, np.uint64, size, 24).reshape(bits, -1)
        return cls(slots, bits, np.frombuffer(data, np.uint8, blocks, 24 + 8 * size), words)


FILTER = "shard long, generation int, n_keys long, ribbon binary"


def shard(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def seal(keys: DataFrame, shard_bits: int = SHARD_BITS, bits: int = BITS) -> DataFrame:
    """(shard, generation, n_keys, ribbon): the filters of keys (generation, key), key distinct in each generation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: tuple[int, int] | None = None

        def made() -> pa.RecordBatch:
            distinct = np.unique(np.concatenate(held)).astype(np.uint64)
            columns = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([len(distinct)], pa.int64()), pa.array([Ribbon.build(distinct, bits).pack()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "generation", "n_keys", "ribbon"])

        for batch in batches:
            s, g, k = (c.to_numpy() for c in batch.columns)
            edges = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (g[1:] != g[:-1])) + 1).tolist(), len(s)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if held and (s[a], g[a]) != at:
                        yield made()
                        held = []
                    at = (int(s[a]), int(g[a]))
                    held.append(k[a:b])
        if held:
            yield made()

    rows = keys.select(shard(F.col("key"), shard_bits).alias("shard"), F.col("generation").cast("int"), "key")
    return rows.repartition(runs.partitions(keys), "shard", "generation").sortWithinPartitions("shard", "generation").mapInArrow(run, FILTER)


def probe(keys: DataFrame, filters: list[list[Part]], shard_bits: int = SHARD_BITS) -> DataFrame:
    """keys (key, generation, after, ...) with `yes`: the first generation between `after` and the key's own whose filter
    says yes, null where none does. Keys are moved by shard; a task reads the filters of its shards from their files."""
    names = [*keys.columns, "yes"]
    at_key, at_own, at_after = (1 + keys.columns.index(c) for c in ("key", "generation", "after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(p.path, "shard") for part in filters for p in part]
        current, sealed = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            key, own, after = (batch.column(c).to_numpy() for c in (at_key, at_own, at_after))
            yes = np.full(len(key), 2**31 - 1, np.int64)
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shards[a] != current:
                    current = shards[a]
                    tables = [t for t in (r.rows(np.array([current])) for r in readers) if t.num_rows]
                    rows = [(g, data) for t in tables for s, g, data in zip(*(t.column(c).to_pylist() for c in ("shard", "generation", "ribbon"))) if s == current]
                    sealed = [(g, Ribbon.unpack(data)) for g, data in sorted(rows)]
                here = np.arange(a, b)
                for g, ribbon in sealed:
                    at = here[(own[here] > g) & (after[here] < g)]
                    if len(at):
                        hit = at[ribbon.contains(key[at].astype(np.uint64))]
                        yes[hit] = g
                        here = np.setdiff1d(here, hit, assume_unique=True)
            known = pa.array(yes.astype(np.int32), pa.int32(), mask=yes == 2**31 - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], known], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)
    placed = keys.select(shard(F.col("key"), shard_bits).alias("_shard"), "*").repartition(runs.partitions(keys), "_shard").sortWithinPartitions("_shard")
    return placed.mapInArrow(run, f"{kinds}, yes int")


def recorded(run: pa.Table, asked: pa.RecordBatch) -> pa.RecordBatch:
    """put_id of the asked rows (key, proof, put_id, yes) whose record is in generation yes."""
    asked_rows = pd.DataFrame({c: asked.column(c).to_numpy() for c in ("key", "proof", "yes", "put_id")})
    have = pd.DataFrame({c: run.column(c).to_numpy() for c in ("key", "proof", "generation")}).rename(columns={"generation": "yes"})
    return pa.RecordBatch.from_arrays([pa.array(asked_rows.merge(have.drop_duplicates(), on=["key", "proof", "yes"])["put_id"].to_numpy().astype(np.int64))], names=["put_id"])


class Seen:
    """The store of sealed generations in a folder: filters, records and their manifest."""

    def __init__(self, spark: SparkSession, folder: str, shard_bits: int = SHARD_BITS, bits: int = BITS) -> None:
        self.spark, self.folder = spark, folder
        fs, path = runs.open_folder(folder)
        kept: dict = {}
        if fs.get_file_info(f"{path}/sealed.json").type != pa.fs.FileType.NotFound:
            with fs.open_input_file(f"{path}/sealed.json") as data:
                kept = json.loads(data.read())
        self.shard_bits, self.bits = kept.get("shard_bits", shard_bits), kept.get("bits", bits)
        self.seals: list[dict] = [{k: [Part(**p) for p in v] if k != "generations" else v for k, v in s.items()} for s in kept.get("seals", [])]

    @property
    def filters(self) -> list[list[Part]]:
        return [s["filters"] for s in self.seals]

    def seal(self, firsts: DataFrame) -> None:
        """Seal the generations of firsts (generation, key, proof), which were not sealed before: new files only."""
        generations = sorted(r.generation for r in firsts.select("generation").distinct().collect())
        if set(generations) & {g for s in self.seals for g in s["generations"]}:
            raise ValueError("a generation is sealed once")
        if not generations:
            return
        records = runs.write_run(firsts.select("key", "proof", "generation"), "key", f"{self.folder}/records", firsts.count())
        filters = runs.write_run(seal(firsts, self.shard_bits, self.bits), "shard", f"{self.folder}/filters", len(generations) << self.shard_bits, 16)
        self.seals.append({"generations": generations, "records": records, "filters": filters})
        fs, path = runs.open_folder(self.folder)
        aside = f"{path}/sealed-{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as out:
            seals = [{k: [asdict(p) for p in v] if k != "generations" else v for k, v in s.items()} for s in self.seals]
            out.write(json.dumps({"shard_bits": self.shard_bits, "bits": self.bits, "seals": seals}).encode())
        fs.move(aside, f"{path}/sealed.json")

    def new(self, firsts: DataFrame) -> DataFrame:
        """(put_id) of firsts (generation, key, proof, put_id) whose key no sealed generation before their own has.

        A round probes what is left, and looks the yes up in the records of the generation that said it; what is not there
        goes on with the filters after that one. A round leaves about 2^-bits of its yes, so there are two or three."""
        at = F.create_map(*(F.lit(x) for n, s in enumerate(self.seals) for g in s["generations"] for x in (g, n))) if self.seals else F.lit(None)
        todo = firsts.select("generation", "key", "proof", "put_id", F.lit(BASE - 1).alias("after"))
        out: DataFrame | None = None
        while True:
            probed = cut(probe(todo, self.filters, self.shard_bits))
            none = probed.where("yes is null").select("put_id")
            out = none if out is None else out.unionByName(none)
            said = probed.where("yes is not null")
            if not self.seals or said.isEmpty():
                return out
            asked = said.select("key", "proof", "put_id", "yes", F.element_at(at, F.col("yes")).cast("int").alias("run"))
            true = runs.visit(asked, "key", Places([s["records"] for s in self.seals]), recorded, "put_id long", only="run")
            todo = cut(said.join(true.distinct(), "put_id", "left_anti").select("generation", "key", "proof", "put_id", F.col("yes").alias("after")))
            if todo.isEmpty():
                return out


def generations(puts: DataFrame) -> DataFrame:
    """(batch, generation): batches in the order of arrival are generations; batches whose ranges of put_id overlap are one,
    since none of them is before the other. A null batch_no is a batch. One row a batch goes to the driver."""
    lowest = F.coalesce(F.col("batch_no").cast("long"), F.lit(-(2**62)))
    each = puts.where("put_id is not null").groupBy(lowest.alias("batch")).agg(F.min("put_id").alias("low"), F.max("put_id").alias("high")).collect()
    out, number, top = [], -1, None
    for r in sorted(each, key=lambda r: (r.low, r.batch)):
        number += top is None or r.low > top
        top = r.high if top is None else max(top, r.high)
        out.append((r.batch, number))
    return puts.sparkSession.createDataFrame(out, "batch long, generation int")


def hashed(hash_text: Column) -> list[Column]:
    """key, the 64 bits that filters see, and proof, 64 more: two hashes agree in both with probability 2^-128."""
    return [F.xxhash64(hash_bytes(hash_text)).alias("key"), F.xxhash64(hash_bytes(hash_text), F.lit("proof")).alias("proof")]


def usable(puts: DataFrame) -> DataFrame:
    return puts.where(hash_bytes(F.col("hash")).isNotNull() & F.col("put_id").isNotNull())


def first_puts(puts: DataFrame) -> DataFrame:
    """(generation, key, proof, put_id): the first put of each hash in each generation. The map side combines, so a hash with
    a third of all rows sends one row a generation and task."""
    batch = F.coalesce(F.col("batch_no").cast("long"), F.lit(-(2**62)))
    rows = usable(puts).select(batch.alias("batch"), *hashed(F.col("hash")), "put_id").groupBy("batch", "key", "proof").agg(F.min("put_id").alias("put_id"))
    return rows.join(generations(puts), "batch").groupBy("generation", "key", "proof").agg(F.min("put_id").alias("put_id"))


def base_keys(base_chunks: DataFrame) -> DataFrame:
    """The fixed chunks as generation BASE: before every put."""
    known = base_chunks.where(hash_bytes(F.col("hash")).isNotNull()).select(F.lit(BASE).alias("generation"), *hashed(F.col("hash")))
    return known.distinct()


def known_puts(puts: DataFrame, base_chunks: DataFrame, folder: str | None = None, **options: int) -> DataFrame:
    """(put_id) of each put whose hash is in base_chunks or was put with a smaller put_id, once each.

    Only the first put of a hash in its generation can be new; every other put with a usable hash is a case. Rows without
    a put_id or usable hash are none; a put delivered twice is one. The store stays in `folder` if one is given."""
    spark = puts.sparkSession
    place = folder or f"{checkpoint_dir(spark).rstrip('/')}/seen-{uuid.uuid4().hex}"
    try:
        runs.open_folder(place)[0].create_dir(runs.open_folder(place)[1])
        seen, firsts = Seen(spark, place, **options), cut(first_puts(puts))
        seen.seal(cut(firsts.select("generation", "key", "proof").unionByName(base_keys(base_chunks))))
        new = seen.new(firsts)
        return usable(puts).select("put_id").distinct().join(new, "put_id", "left_anti")
    finally:
        if folder is None:
            runs.drop_folder(place)


def audit(puts: DataFrame, base_chunks: DataFrame, probes: int = 400_000, **options: int) -> DataFrame:
    """(scope, generation, n_filters, n_keys, n_probes, n_wrong, rate, expected): wrong answers, by keys that are certainly
    absent: of each generation's filter (scope filter), and of decisions by all filters up to and with a generation (scope
    decision), which are wrong if one of them is. Wrong ones of p4_found are none, as each yes is looked up.

    An absent key is the 64-bit hash of a text that is no hash, taken only if no stored key has the same 64 bits."""
    spark = puts.sparkSession
    place = f"{checkpoint_dir(spark).rstrip('/')}/seen-{uuid.uuid4().hex}"
    try:
        runs.open_folder(place)[0].create_dir(runs.open_folder(place)[1])
        seen = Seen(spark, place, **options)
        keys = cut(first_puts(puts).select("generation", "key", "proof").unionByName(base_keys(base_chunks)))
        seen.seal(keys)
        made = spark.range(probes).select(F.xxhash64(F.concat(F.lit("absent key "), F.col("id").cast("string"))).alias("key"))
        absent = cut(made.join(keys.select("key").distinct(), "key", "left_anti"))
        filters, bits = seen.filters, seen.shard_bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers = [Reader(p.path, "shard") for part in filters for p in part]
            for batch in batches:
                s, key = (c.to_numpy() for c in batch.columns)
                at, wrong = [], []
                for one in np.unique(s).tolist():
                    mine = np.flatnonzero(s == one)
                    for r in readers:
                        t = r.rows(np.array([one]))
                        for shard_no, g, data in zip(*(t.column(c).to_pylist() for c in ("shard", "generation", "ribbon"))):
                            if shard_no == one:
                                hit = mine[Ribbon.unpack(data).contains(key[mine].astype(np.uint64))]
                                at += key[hit].tolist()
                                wrong += [g] * len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(wrong, pa.int32())], names=["key", "generation"])

        placed = absent.select(shard(F.col("key"), bits).alias("s"), "key").repartition(runs.partitions(absent), "s").sortWithinPartitions("s")
        hits = cut(placed.mapInArrow(run, "key long, generation int"))
        n_probes, sizes = absent.count(), keys.groupBy("generation").agg(F.count("*").alias("n_keys"))
        counts = sizes.join(hits.groupBy("generation").agg(F.count("*").alias("n_wrong")), "generation", "left").fillna(0, ["n_wrong"])
        filters_ = counts.select(F.lit("filter").alias("scope"), "generation", F.lit(1).cast("long").alias("n_filters"), "n_keys", "n_wrong")
        first = hits.groupBy("key").agg(F.min("generation").alias("first"))
        upto = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # one row a generation
        total = sizes.join(first.groupBy(F.col("first").alias("generation")).agg(F.count("*").alias("n")), "generation", "left").fillna(0, ["n"])
        wrong = total.select("generation", F.count("*").over(upto).alias("n_filters"), F.sum("n_keys").over(upto).alias("n_keys"), F.sum("n").over(upto).alias("n_wrong"))
        rows = filters_.unionByName(wrong.select(F.lit("decision").alias("scope"), "*"))
        expected = 1 - F.pow(F.lit(1 - 2.0**-seen.bits), F.col("n_filters"))
        out = rows.select("scope", "generation", "n_filters", "n_keys", F.lit(n_probes).cast("long").alias("n_probes"), "n_wrong", F.try_divide(F.col("n_wrong"), F.lit(n_probes)).alias("rate"), expected.alias("expected"))
        return cut(out)
    finally:
        runs.drop_folder(place)
