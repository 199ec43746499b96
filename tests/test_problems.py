"""The general data problems on small inputs: nulls, ties, copies, empty tables, clashing columns, brute force."""

import datetime as dt
import hashlib
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.functions.keys import norm_hash, norm_path
from cairnlake.operators import compaction, orphans, snapshots
from cairnlake.operators.hierarchy import hierarchy
from cairnlake.operators.ranks import running

T = dt.datetime
A, B, C = ("%064x" % k for k in (10, 11, 12))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_normal_forms(spark):
    df = spark.createDataFrame([(f" {A.upper()}\n",), (f"blake3:{A}",), (f"B3: {A} ",), ("",), ("  ",), (None,)], "h string")
    assert [r[0] for r in df.select(norm_hash(F.col("h"))).collect()] == [A, A, A, None, None, None]
    df = spark.createDataFrame([("./a//b\\c.txt",), (".\\ü.md",), ("A/b",), ("././x",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(norm_path(F.col("p"))).collect()] == ["a/b/c.txt", "ü.md", "A/b", "x", "", None]


def test_orphans_states(spark):
    raw = spark.createDataFrame([(1, [A, f"b3:{A}", None, ""], T(2025, 1, 5)), (2, [B, C], T(2025, 2, 1)), (2, [B, C], T(2025, 2, 1)), (3, None, None), (4, [C], None)], "id long, hs array<string>, at timestamp_ntz")
    refs = orphans.references(raw, "t", F.col("id"), F.col("hs"), F.col("at"))
    chunks = spark.createDataFrame([(B, T(2025, 1, 1), T(2025, 1, 2), "x"), (C, T(2025, 3, 1), None, "x"), (C, T(2025, 4, 1), T(2025, 5, 1), "x")], "hash string, created_at timestamp_ntz, deleted_at timestamp_ntz, target_hash string")
    always = spark.createDataFrame([], "hash string")
    got = rows(orphans.orphan_references(refs, chunks, always).select("ref_id", "target_hash", "ref_state"))
    assert got == sorted([(1, A, "missing"), (2, B, "deleted"), (2, C, "late")], key=str)
    assert rows(orphans.orphan_references(refs, chunks, spark.createDataFrame([(A.upper(),)], "hash string")).select("ref_id").distinct()) == [(2,)]
    assert orphans.orphan_references(refs.limit(0), chunks, always).count() == 0
    for hot_rows in (0, 2):  # every key is hot, or one
        assert rows(orphans.orphan_references(refs, chunks, always, hot_rows).select("ref_id", "target_hash", "ref_state")) == got
    assert orphans.orphan_references(refs, chunks.limit(0), always).where("ref_state <> 'missing'").count() == 0


def test_snapshot_changes(spark):
    man = spark.createDataFrame([("m1", "r", "b", 1, T(2025, 1, 1)), ("m2", "r", "b", 5, T(2024, 1, 1)), ("m2", "r", "b", 5, T(2024, 1, 1)), ("m3", "r", "b", 9, T(2025, 1, 1)), (None, "r", "b", 7, None)], "manifest string, repo string, branch string, seq int, taken_at timestamp_ntz")
    e = [("m1", "./x", A, T(2025, 1, 1), 1), ("m1", "x", B, T(2025, 1, 2), 2), ("m1", "n", None, None, 3), ("m2", "x", f"b3:{B}", T(2025, 1, 1), 4), ("m2", "n", "", None, 5), ("m2", "X", A, None, 6), ("m2", None, A, None, 7)]
    ent = spark.createDataFrame(e, "manifest string, path string, content_hash string, recorded_at timestamp_ntz, entry_id long").withColumn("seq", F.lit(0))
    got = rows(snapshots.snapshot_changes(man, ent).select("seq", "path", "change_kind"))
    assert got == sorted([(5, "X", "added"), (9, "x", "removed"), (9, "n", "removed"), (9, "X", "removed")], key=str)
    assert rows(snapshots.snapshot_changes(man, ent, max_broadcast_rows=0).select("seq", "path", "change_kind")) == got
    assert snapshots.snapshot_changes(man, ent.limit(0)).count() == 0
    assert snapshots.snapshot_changes(man.limit(0), ent).count() == 0


def brute_graph(nodes, links):
    parents, down = defaultdict(set), defaultdict(set)
    for c, p in links:
        parents[c].add(p)
        down[p].add(c)
    out = set()
    for r in nodes:
        if parents[r]:
            continue
        seen, todo = {r: 0}, deque([r])
        while todo:
            x = todo.popleft()
            for y in down[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        out |= {(x, r, n) for x, n in seen.items()}
    cyc = set()
    for x in nodes:
        seen, todo = set(), list(parents[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += parents[y]
        if x in seen:
            cyc.add((x,))
    return out, cyc


@pytest.mark.parametrize("seed", [0, 1])
def test_hierarchy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k:03d}" for k in range(70)]
    links = {(nodes[k], nodes[k - 1]) for k in range(1, 30)}  # a chain
    links |= {(nodes[rng.randrange(30, 70)], nodes[rng.randrange(0, 66)]) for _ in range(45)}
    links |= {(nodes[60], nodes[62]), (nodes[62], nodes[61]), (nodes[61], nodes[60]), (nodes[69], nodes[69])} if seed else set()
    df = spark.createDataFrame([(c, p, rng.randrange(3), "x") for c, p in links] * 2 + [("gone", nodes[0], 0, "x"), (None, None, None, None)], "child string, parent string, ord int, node string")
    g = hierarchy(spark.createDataFrame([(n,) for n in [*nodes, nodes[0], None]], "node string"), df)
    want, cyc = brute_graph(nodes, links)
    assert {tuple(r) for r in g.root_links().collect()} == want
    assert {tuple(r) for r in g.on_cycles.collect()} == cyc
    got = {r["node"]: r for r in g.nested.collect()}
    assert sorted(r["pre"] for r in got.values()) == list(range(len(nodes)))
    for r in got.values():  # ranges are nested and sizes count them
        inside = [x for x in got.values() if r["pre"] <= x["pre"] < r["pre"] + r["size"]]
        assert len(inside) == r["size"]
        if r["parent"]:
            p = got[r["parent"]]
            assert p["pre"] < r["pre"] < p["pre"] + p["size"] and r["depth"] == p["depth"] + 1
    below = defaultdict(set)
    for r in g.descendants(g.nodes).collect():
        below[r["node"]].add(r["descendant"])
    assert all(len(below[n]) == r["size"] - 1 for n, r in got.items())
    paths = {r["node"]: r for r in g.with_paths().collect()}
    for n, r in paths.items():
        if not r["unprocessed"]:
            assert r["path"].split("/")[-1] == n and len(r["path"].split("/")) == r["depth"] + 1


def test_hierarchy_empty(spark):
    g = hierarchy(spark.createDataFrame([], "node string"), spark.createDataFrame([], "child string, parent string, ord int"))
    assert g.root_links().count() == 0 and g.on_cycles.count() == 0 and g.nested.count() == 0


def test_running_is_the_same_in_parts(spark):
    data = [(None if k % 5 == 0 else k % 3, k, k * 7 % 11) for k in range(200)]
    df = spark.createDataFrame(data, "g int, id int, v int")
    for parts in (1, 6):
        got = running(df, ["g"], "id", parts, before=F.col("v")).collect()
        by = defaultdict(list)
        for r in got:
            by[r["g"]].append(r)
        for rs in by.values():
            rs.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in rs] == list(range(len(rs)))
            assert [r["before"] for r in rs] == list(np.cumsum([0] + [r["v"] for r in rs])[:-1])


def test_bin_plan_never_overfills():
    rng = np.random.default_rng(3)
    for _ in range(30):
        h = np.zeros(18, np.int64)
        for c in rng.integers(1, 18, rng.integers(0, 60)):
            h[c] += 1
        plan = compaction.plan_bins(h, 16, 16)
        used, seen = defaultdict(int), defaultdict(int)
        for c, r, n, first, each in sorted(plan.classes):
            assert r == seen[c]
            seen[c] += n
            for k in range(n):
                used[first + k // each] += c
        assert all(seen[c] == h[c] for c in range(1, 18))
        assert all(v <= 16 or v == 17 for v in used.values())
        assert len(used) == plan.n_bins and plan.n_bins <= 1.7 * sum(c * h[c] for c in range(18)) / 16 + 1 + h[17]


def test_compaction_round_trip(spark, tmp_path):
    rng = random.Random(1)
    data = []
    for k in range(300):
        body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 3, 40, 400, 3000, 9000])))
        data.append((k, hashlib.sha256(body).hexdigest(), body, "x"))
    data += [(300, data[5][1].upper(), data[5][2], "x"), (301, "blake3:" + data[5][1], data[5][2], "x"), (302, A, data[5][2], "x"), (303, data[5][1], None, "x"), (304, None, b"z", "x"), (305, "", b"z", "x"), data[7]]
    df = spark.createDataFrame(data, "file_id long, hash string, data binary, bin string")
    done = compaction.compact(df, str(tmp_path / "out"), target_bytes=8192)
    firsts, dups = {}, set()
    for i, h, b, _ in sorted(data[:303], key=lambda r: r[0]):
        key = (h.lower().split(":")[-1], b)
        if key in firsts and firsts[key] != i:
            dups.add(i)
        firsts.setdefault(key, i)
    assert {r[0] for r in done.duplicates.collect()} == dups
    out = spark.read.parquet(str(tmp_path / "out"))
    kept = {i for i, *_ in data} - dups
    assert sorted(r[0] for r in out.select("file_id").collect()) == sorted(kept)
    assert max(r["n_bytes"] for r in done.files().collect() if r["n_records"] > 1) <= 8192
    with pytest.raises(FileExistsError):
        compaction.compact(df, str(tmp_path / "out"), target_bytes=8192)
    empty = compaction.compact(df.limit(0), str(tmp_path / "none"))
    assert empty.duplicates.count() == 0 and empty.files().count() == 0


def test_compaction_keeps_different_records_of_one_id(spark, tmp_path):
    """Two rows with one file_id and different data, one of them listed twice, beside another file: three records."""
    data = [(1, A, b"one"), (1, A, b"two"), (1, A, b"two"), (2, A, b"three"), (3, A, b"two"), (None, None, None)]
    done = compaction.compact(spark.createDataFrame(data, "file_id long, hash string, data binary"), str(tmp_path / "out"))
    got = compaction.read_compacted(spark, str(tmp_path / "out")).select("file_id", "data").collect()
    assert sorted(((r["file_id"], bytes(r["data"] or b"")) for r in got), key=str) == sorted([(1, b"one"), (1, b"two"), (2, b"three"), (None, b"")], key=str)
    assert [r[0] for r in done.duplicates.collect()] == [3]


def test_compaction_finds_damage(spark, tmp_path, monkeypatch):
    data = [(k, A, bytes([k]) * 100) for k in range(50)]
    df = spark.createDataFrame(data, "file_id long, hash string, data binary")
    write = compaction._write
    for spoil in (lambda d: d.where("file_id <> 7"), lambda d: d.unionAll(d.where("file_id = 7")), lambda d: d.withColumn("data", F.when(F.col("file_id") == 7, F.lit(b"x")).otherwise(F.col("data")))):

        def spoiled(done, at, spoil=spoil):
            write(done, at + "-good")
            spoil(spark.read.parquet(at + "-good")).write.partitionBy("folder").parquet(at)

        monkeypatch.setattr(compaction, "_write", spoiled)
        with pytest.raises(compaction.VerificationError):
            compaction.compact(df, str(tmp_path / "bad"), target_bytes=1024)
        assert not (tmp_path / "bad").exists()
    with pytest.raises(FileNotFoundError):
        compaction.read_compacted(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize("target", [40, 64, 100, 8192, 256 << 20])
def test_size_classes_hold_their_files(spark, target):
    sizes = compaction.size_classes(target)
    assert sizes == sorted(sizes) and sizes[-1] == target and len(sizes) < 600
    weights = sorted({w for s in sizes[1:] for w in (s - 3, s - 2, s - 1, s, s + 1) if w > 0} | {1, 2 * target})
    df = spark.createDataFrame([(w,) for w in weights], "w long").select("w", compaction.class_of(F.col("w"), target).alias("c"))
    for w, c in df.collect():
        assert (c == len(sizes)) if w > target else (1 <= c < len(sizes) and w <= sizes[c])


def test_streams_drop_late_rows(spark, tmp_path):
    """Files in order: the second moves the watermark on, which holds for late rows from the batch after the next."""
    from cairnlake.streaming import twins

    at = lambda h, m=0: T(2025, 1, 1, h, m)
    files = [[(at(1), "a", 1.0), (at(1, 30), "a", 2.0)], [(at(5), "a", 4.0)], [(at(5, 5), "a", 64.0)], [(at(1, 40), "a", 8.0), (at(5, 10), "a", 16.0)], [(at(9), "a", 32.0)]]
    like = spark.createDataFrame([], "ts timestamp_ntz, event_type string, value double")
    for k, rows_ in enumerate(files):
        spark.createDataFrame(rows_, like.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    src = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/part=*")
    got = {r["bucket"]: (r["n"], r["total"]) for r in twins.drained(twins.windowed_counts(src, "1 hour"), "append").collect()}
    assert got[at(1)] == (2, 3.0) and got[at(5)] == (3, 84.0)


def test_readers_and_sinks(spark, tmp_path):
    from cairnlake.sources import files as S

    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/a.txt").write_bytes(b"one")
    (tmp_path / "tree/sub/b.wav").write_bytes(b"")
    (tmp_path / "tree/sub/c.md").write_bytes(b"x")
    got = {r["path"]: (r["size"], r["content_hash"]) for r in S.scan_worktree(spark, str(tmp_path / "tree"), ["*.wav"]).collect()}
    assert got == {"a.txt": (3, hashlib.sha256(b"one").hexdigest()), "sub/c.md": (1, hashlib.sha256(b"x").hexdigest())}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/1.json").write_text('{"name": "p",\n "n": 1}')
    (tmp_path / "docs/2.json").write_text("{bad")
    assert [tuple(r)[1:] for r in S.read_documents(spark, str(tmp_path / "docs"), "name string, n long").collect()] == [("p", 1)]
    (tmp_path / "locks.json").write_text('{"a/b": {"owner": "me", "acquired_at": "2025-01-01T00:00:00", "expires_at": null}}')
    assert [(r["path"], r["owner"], r["reason"]) for r in S.read_locks(spark, str(tmp_path / "locks.json")).collect()] == [("a/b", "me", None)]
    (tmp_path / "acc").mkdir()
    (tmp_path / "acc/1.json").write_text('[{"hash": "h", "size": 1}, {"hash": null}, {"hash": "h", "size": 2}]')
    (tmp_path / "acc/2.json").write_text("[")
    assert [(r["hash"], r["size"]) for r in S.read_access(spark, str(tmp_path / "acc")).collect()] == [("h", 2)]
    store = str(tmp_path / "store")
    put = lambda *rows_: rows(S.put_if_absent(spark.createDataFrame(rows_, "hash string, data binary"), store))
    assert put((A, b"a"), (A.upper(), b"a"), (None, b"n")) == [(A, True)]
    assert put((A, b"a"), (B, None)) == sorted([(A, False), (B, True)], key=str)
    assert S.stored(spark, store).count() == 2
    e = lambda *ids: spark.createDataFrame([(i, T(2025, 1, 1), "x", "success", None, 1, 0.5) for i in ids], S.AUDIT_SCHEMA)
    S.append_audit(e(1, 2, 3), str(tmp_path / "log"), 4)
    S.append_audit(e(4, 5), str(tmp_path / "log"), 4)
    assert sorted(r["id"] for r in S.audit_log(spark, str(tmp_path / "log"))[1].collect()) == [2, 3, 4, 5]
    S.archive(spark.createDataFrame([("r", "a/x"), ("r", "b/x")], "repo string, path string"), str(tmp_path / "ar"), "a/")
    assert [r["path"] for r in spark.read.json(str(tmp_path / "ar")).collect()] == ["a/x"]


def test_file_kinds_and_storage(spark):
    from cairnlake.functions import scalars as S

    cases = [("a.MP4", b"", "video", "binary"), ("x/y.exr", b"", "video", "binary"), ("m.blend", b"", "model3d", "binary"), ("p.xml", b"", "project", "text"), ("p.prproj", b"", "project", "hybrid"), ("u.uasset", b"", "game_asset", "binary"), ("s.rs", b"", "text", "text"),
             (".gitignore", b"\0", "binary", "text"), ("go.mod", b"\0", "binary", "text"), ("x.unknown", b"", "binary", "text"), ("x.unknown", b"a\nb\n", "binary", "text"), ("x.unknown", b"ab" + b"\0", "binary", "binary"), ("x.unknown", b"a" * 8192 + b"\0", "binary", "binary"),
             ("x.unknown", (b"a" * 100 + b"\n") * 90 + b"\0", "binary", "text"), ("x.unknown", b"\xff\xfe", "binary", "binary"), ("x.unknown", b"a" * 499, "binary", "text"), ("x.unknown", b"a" * 500, "binary", "binary"), ("x.unknown", "ü".encode() * 250, "binary", "binary"), ("x.unknown", None, "binary", "binary"), ("a.psd", None, "image", "binary")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, path string, data binary, kind string, storage string")
    for r in df.select("k", "path", "kind", "storage", S.file_kind(F.col("path")).alias("got_kind"), S.storage_of(F.col("path"), F.col("data")).alias("got")).collect():
        assert (r["got_kind"], r["got"]) == (r["kind"], r["storage"]), r


def test_policy_conditions_and_merge_conflicts(spark):
    from cairnlake.operators import lifecycle as L
    from cairnlake.operators import trees as op

    now = F.lit("2025-12-31").cast("timestamp_ntz")
    rec = spark.createDataFrame([("a", 1, "hot", T(2025, 1, 1), T(2025, 12, 30), 2, False, False), ("b", 1, "hot", T(2025, 12, 1), T(2025, 12, 30), 9, False, False), ("c", 1, "warm", T(2025, 12, 1), T(2025, 12, 30), 9, True, False)], "hash string, size long, tier string, created_at timestamp_ntz, last_accessed timestamp_ntz, access_count long, is_proxy boolean, is_manifest boolean")
    rule = lambda *rs: spark.createDataFrame(rs, "priority int, from_tier string, to_tier string, cond_type string, cond_value long, exclude_protected boolean")
    fired = lambda *rs: rows(L.evaluate(rec, rule(*rs), now).select("hash", "to_tier"))
    assert fired((1, "hot", "cold", "age_days", 100, True)) == [("a", "cold")]
    assert fired((1, "hot", "cold", "access_count_below", 9, True)) == [("a", "cold")]
    assert fired((1, "hot", "cold", "always", 0, True), (2, "warm", "cold", "always", 0, True)) == [("a", "cold"), ("b", "cold")]
    assert fired((1, "warm", "cold", "always", 0, False)) == [("c", "cold")]
    assert fired((2, "hot", "cold", "always", 0, True), (1, "hot", "warm", "access_count_below", 5, True)) == [("a", "warm"), ("b", "cold")]
    tree = lambda **paths: spark.createDataFrame([("r", "b", p, h) for p, h in paths.items()], "repo string, branch string, path string, content_hash string")
    base, ours, theirs = tree(a="1", b="1", c="1", d="1", e="1", f="1"), tree(a="2", c="2", d="2", f="1", n="1", s="7", e="3"), tree(a="3", b="2", d="2", f="2", n="2", s="7", e="1")
    got = {r["path"]: r["outcome"] for r in op.three_way(base, ours, theirs).collect()}
    assert got == {"a": "both_modified", "b": "delete_modify", "c": "modify_delete", "d": "same", "e": "ours", "f": "theirs", "n": "both_added", "s": "same"}
    old, new = tree(a="1", b="2"), tree(a="1", c="1", d="2")
    assert [r["path"] for r in op.copies(old, new).collect()] == ["c"]
    assert [(r["old_path"], r["new_path"]) for r in op.renames(old, new).collect()] == [("b", "d")]
    sync = lambda df: df.withColumn("chunks", F.array(F.struct(F.concat(F.lit("B3: "), "content_hash").alias("hash"), F.lit(5).cast("long").alias("size"))))
    assert rows(op.sync_diff(sync(new), sync(old)).select("path", "change", "n_new", "n_kept", "n_removed", "transfer_bytes")) == [("a", "M", 0, 1, 0, 0), ("b", "D", 0, 0, 1, 0), ("c", "A", 1, 0, 0, 5), ("d", "A", 1, 0, 0, 5)]
