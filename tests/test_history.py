from helpers import h, rng
from pyspark.sql import functions as F

from cairn.functions.patterns import VersionRef
from cairn.operators import diff, gc, history, lineage, sync

M = "id string, parent string, repo_id bigint, message string, ts bigint, tags array<string>"


def manifests(spark, links, message=lambda i: "m"):
    return spark.createDataFrame([(i, p, 1, message(i), k, []) for k, (i, p) in enumerate(links)], M)


def chain(n, name="s"):
    return [(f"{name}{k}", f"{name}{k - 1}" if k else None) for k in range(n)]


def refs(spark, targets):
    rows = [(k, name, "tag" if name.startswith("tags/") else "HEAD" if name == "HEAD" else "branch", t, s) for k, (name, t, s) in enumerate(targets)]
    return spark.createDataFrame(rows, "ref_id bigint, name string, type string, target string, symref string")


def test_depths(spark, rows):
    m = manifests(spark, chain(70) + [("f", "s3"), ("lost", "nowhere"), ("a", "b"), ("b", "a"), ("self", "self")])
    got = {i: (d, r) for i, d, r in rows(lineage.depths(m))}
    assert all(got[f"s{k}"] == (k, "s0") for k in range(70))
    assert got["f"] == (4, "s0") and got["lost"] == (0, "lost") and got["a"][1] is got["self"][1] is None
    assert rows(lineage.depths(m.limit(0))) == []


def test_reachable(spark, rows):
    m = manifests(spark, chain(40) + [("f", "s3"), ("x", "gone"), ("a", "b"), ("b", "a")])
    roots = spark.createDataFrame([("f",), ("x",), ("gone",), ("a",), (None,)], "id string")
    assert [r[0] for r in rows(lineage.reachable(m, roots))] == sorted(["f", "s0", "s1", "s2", "s3", "x", "a", "b"], key=repr)
    assert rows(lineage.reachable(m, roots.limit(0))) == []


def test_ancestry(spark):
    r = rng(2)
    links = [(str(k), str(r.randrange(k)) if k and r.random() < 0.95 else None) for k in range(60)]
    up = dict(links)
    pairs = [(str(r.randrange(60)), str(r.randrange(60))) for _ in range(200)] + [("none", "3"), ("3", "none"), ("none", "none")]

    def want(a, b):
        if a == b:
            return True
        if a not in up:
            return None
        while a is not None:
            if a == b:
                return True
            a = up.get(a)
        return False

    cols = lineage.ancestry(manifests(spark, links), spark.createDataFrame(sorted(set(pairs)), "descendant string, ancestor string")).select("descendant", "ancestor", "is_ancestor").collect()
    assert all(c.is_ancestor == want(c.descendant, c.ancestor) for c in cols) and len(cols) == len(set(pairs))


def test_symrefs(spark):
    hops = [(f"r{k}", None, f"r{k + 1}") for k in range(12)] + [("r12", "end", None), ("loop", None, "loop"), ("broken", None, "missing"), ("plain", "t", None), ("none", None, None)]
    df = refs(spark, hops).select(F.lit(1).alias("repo_id"), "name", "target", "symref")
    got = {r.name: r.resolved for r in lineage.resolve_symrefs(df, ["repo_id"]).collect()}
    assert got["r4"] == "end" and got["r3"] is None and got["loop"] is got["broken"] is got["none"] is None and got["plain"] == "t"


def test_garbage(spark, rows):
    s1, s2, s3, auto = (h(x) for x in ("s1", "s2", "s3", "auto"))
    m = spark.createDataFrame([(s1, None, 1, "m", 1, []), (s2, s1, 1, "m", 2, []), (s3, None, 1, "m", 3, []), (auto, None, 1, "auto - snapshot 1", 4, [])], M)
    entries = spark.createDataFrame([(s1, [h("c1")]), (s2, [h("c2"), None]), (s3, [h("c3")]), (auto, [h("c4")])], "snapshot_id string, chunks array<string>")
    index = spark.createDataFrame([([h("c5"), "bad"],), (None,)], "chunks array<string>")
    chunks = spark.createDataFrame([(h(f"c{k}"), 100 * k, None) for k in range(1, 7)] + [(None, 1, None)], "hash string, size bigint, deleted_at string")
    reached = lineage.reachable(m, gc.roots(refs(spark, [("heads/main", s2, None), ("HEAD", None, "heads/main"), ("tags/zero", "0" * 64, None)])))
    lost = m.join(reached, "id", "left_anti")
    for keep, want in ((0, (2, 0, 3, 1300)), (1, (1, 1, 2, 900))):
        kept = gc.kept_autos(lost, keep)
        live = gc.live_chunks(reached.unionByName(kept.select("id")), entries, index)
        assert gc.report(lost, kept, gc.dead_chunks(chunks, live)).first()[:] == want


def test_prune_ranks_all_autos(spark, rows):
    m = spark.createDataFrame([(f"a{k}", None, 1, f"auto - snapshot {k}", k, []) for k in range(5)] + [("m", None, 1, "manual", 9, [])], M)
    reached = spark.createDataFrame([("a0",), ("a4",)], "id string")
    assert [r[0] for r in rows(gc.prunable_autos(m, reached, 2, ["repo_id"]).select("id"))] == ["a1", "a2"]
    assert [r[0] for r in rows(gc.kept_autos(m.join(reached, "id", "left_anti"), 2).select("id"))] == ["a2", "a3"]


def test_packs(spark, rows):
    packs = spark.createDataFrame([("p1", "a", 1), ("p1", "b", 2), ("p1", "c", 4), ("p2", "d", 8), ("p3", "e", 16), ("p3", "f", 32), ("p3", "g", 64)], "pack string, hash string, length bigint")
    live = spark.createDataFrame([("a",), ("e",), ("f",)], "hash string")
    assert rows(gc.pack_plan(packs, live)) == [("p1", 3, 2, 6, "rewrite"), ("p2", 1, 1, 8, "drop"), ("p3", 3, 1, 64, "keep")]
    assert gc.next_pack(spark.createDataFrame([("pack-000012",), ("pack-7",), ("odd",)], "pack string")).first()[0] == 13
    assert gc.next_pack(packs.limit(0)).first()[0] == 1
    loose = spark.range(600).select(F.col("id").cast("string").alias("hash"))
    assert gc.loose_plan(loose, loose.where("hash != '5'")).first()[:] == (1, 599)
    assert gc.loose_plan(loose.limit(10), loose).first()[:] == (0, 0)


def test_log(spark):
    m = spark.createDataFrame([(f"{k:04d}", f"{k - 1:04d}" if k else None, 1, "auto - x" if k % 5 == 0 else None if k == 7 else "m", 100, ["t", ""]) for k in range(60)], M)
    log = history.newest_first(history.visible(m), lineage.depths(m), 30)
    assert [r.id for r in log.collect()] == [f"{k:04d}" for k in range(59, -1, -1) if k % 5][:30]
    assert history.newest_first(history.visible(m, True), lineage.depths(m), 0).count() == 60
    assert [r.id for r in history.newest_first(m, lineage.depths(m), 2, 3).collect()] == ["0056", "0055"]
    assert history.newest_first(m, lineage.depths(m), 5, 100).collect() == []


def test_decoration_and_resolution(spark, rows):
    a, b = h("a"), h("b")
    m = spark.createDataFrame([(a, None, 1, "m", 1, ["v0", "", None, "v1"]), (b, a, 1, "m", 2, None)], M)
    r = refs(spark, [("HEAD", None, "heads/main"), ("heads/main", b, None), ("heads/dev", b.upper(), None), ("tags/v1", a, None), ("tags/gone", h("gone"), None), ("heads/zero", "0" * 64, None)])
    got = {x.id: (x.branches, x.all_tags) for x in history.decorate(m, r).collect()}
    assert got == {a: ([], ["v0", "v1"]), b: (["dev", "main"], [])}
    assert [(x.tag, x.message, x.ts) for x in history.tag_list(r, m).collect()] == [("gone", "", 0), ("v1", "m", 1)]
    for ref, want in ((VersionRef("head"), [b]), (VersionRef("tag", "v1"), [a]), (VersionRef("branch", "dev"), [b]), (VersionRef("id", a[:5]), [a]), (VersionRef("tag", "gone"), []), (VersionRef("branch", "zero"), [])):
        assert [x.id for x in history.resolve(ref, m, r).collect()] == want
    assert {x.status for x in history.prefix_matches(spark.createDataFrame([("abcd1",), ("abcd2",), ("ef011",)], "id string"), 4).collect()} == {"ambiguous", "unique"}


def test_push_and_pull(spark):
    ids = {k: h(k) for k in ("base", "child", "left", "right")}
    m = manifests(spark, [(ids["base"], None), (ids["child"], ids["base"]), (ids["left"], ids["base"]), (ids["right"], ids["base"])])
    local = refs(spark, [("same", ids["base"], None), ("ahead", ids["child"], None), ("behind", ids["base"], None), ("split", ids["left"], None), ("none", None, None), ("own", ids["base"], None)])
    remote = refs(spark, [("same", ids["base"], None), ("ahead", ids["base"], None), ("behind", ids["child"], None), ("split", ids["right"], None), ("none", ids["base"], None), ("zero", None, None), ("theirs", ids["base"], None)])
    push = {r.name: r.action for r in sync.classify_push(local, remote, m, key="name").collect()}
    assert push == {"same": "same", "ahead": "update", "behind": "diverge", "split": "diverge", "none": "skip", "own": "create"}
    pull = {r.name: (r.action, r.new_name) for r in sync.merge_pull(local, remote, m, key="name").collect()}
    assert pull == {"same": ("same", "same"), "ahead": ("side", "ahead.remote"), "behind": ("forward", "behind"), "split": ("side", "split.remote"), "none": ("forward", "none"), "zero": ("skip", "zero"), "theirs": ("create", "theirs")}


F_ = "path string, file_hash string, size bigint, mod_time bigint"


def test_file_diffs(spark):
    a = spark.createDataFrame([("a", "AA", 10, 1), ("b", "BB", 20, 1), ("c", "CC", 30, 1), ("n", None, None, None)], F_)
    b = spark.createDataFrame([("a", "AA", 10, 2), ("b", "BB01", 25, 1), ("d", "DD", 40, 1), ("n", None, None, None)], F_)
    assert {r.path: r.status for r in diff.snapshot_diff(a, b).collect()} == {"b": "modified", "c": "deleted", "d": "added"}
    assert {r.path: r.status for r in diff.status(a, b).collect()} == {"a": "modified", "b": "modified", "c": "deleted", "d": "added"}
    assert [(r.path, r.action) for r in diff.restore_plan(a, b).collect()] == [("b", "overwrite"), ("c", "delete"), ("d", "write")]
    assert diff.snapshot_diff(a, a).collect() == [] and diff.snapshot_diff(a.limit(0), a.limit(0)).collect() == []
    flip = {"added": "deleted", "deleted": "added", "modified": "modified"}
    assert {(r.path, flip[r.status]) for r in diff.snapshot_diff(b, a).collect()} == {(r.path, r.status) for r in diff.snapshot_diff(a, b).collect()}
    assert not diff.merge_saved(a, a)[1].first()[0] and diff.merge_saved(a, b)[1].first()[0] and not diff.merge_saved(a.limit(0), a.limit(0))[1].first()[0]
    links = spark.createDataFrame([("l", "x", 1, 1, True)], F_ + ", is_symlink boolean")
    assert diff.status(a.limit(0), links).collect() == []


def test_hash_and_chunk_keys_agree(spark):
    f = "path string, file_hash string, size bigint, chunks array<string>"
    a = spark.createDataFrame([("a", h("1"), 1, ["1"]), ("b", h("2"), 1, ["2"])], f)
    b = spark.createDataFrame([("a", h("1"), 1, ["1"]), ("b", h("3"), 1, ["3"])], f)
    by = [diff.file_diff(a, b, c, values=["file_hash", "size", "chunks"]).select("path", "status") for c in (diff.by_hash(), diff.by_chunks())]
    assert sorted(by[0].collect()) == sorted(by[1].collect())


def test_side_references_and_broken_chains(spark):
    """A side reference that holds another target is not overwritten; a chain that ends at a missing snapshot says nothing."""
    ids = {k: h(k) for k in "abcdx"}
    manifests = spark.createDataFrame([(ids["a"], None), (ids["b"], ids["a"]), (ids["c"], ids["a"]), (ids["d"], ids["x"])], "id string, parent string")
    refs = "name string, type string, target string"
    local = spark.createDataFrame([("heads/m", "branch", ids["b"]), ("heads/m.remote", "branch", ids["a"]), ("heads/k", "branch", ids["b"]), ("heads/k.remote", "branch", ids["c"]), ("heads/l", "branch", ids["b"])], refs)
    remote = spark.createDataFrame([(n, "branch", ids["c"]) for n in ("heads/m", "heads/k", "heads/l")], refs)
    got = {r.name: r.new_name for r in sync.merge_pull(local, remote, manifests, key="name").collect()}
    assert got == {"heads/m": f"heads/m.remote.{ids['c'][:8]}", "heads/k": "heads/k.remote", "heads/l": "heads/l.remote"}
    pairs = spark.createDataFrame([(ids["d"], ids["a"]), (ids["d"], ids["d"]), (ids["b"], ids["c"]), (ids["b"], ids["a"]), (ids["x"], ids["a"])], "descendant string, ancestor string")
    found = {(r.descendant, r.ancestor): r.is_ancestor for r in lineage.ancestry(manifests, pairs).collect()}
    assert [found[ids[x], ids[y]] for x, y in ("da", "dd", "bc", "ba", "xa")] == [None, True, False, True, None]
    pushed = sync.classify_push(spark.createDataFrame([("heads/m", "branch", ids["d"])], refs), spark.createDataFrame([("heads/m", "branch", ids["a"])], refs), manifests, key="name")
    assert pushed.first().action == "broken"
