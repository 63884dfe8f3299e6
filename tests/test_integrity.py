import hashlib

from pyspark.sql import functions as F

from hostlens.operators import integrity as I

COLUMNS = ["ts", "message"]


def chain(spark, n=6):
    df = spark.createDataFrame([("h", k, f"t{k}", f"m{k}" if k != 3 else None) for k in range(1, n + 1)], "host string, id long, ts string, message string")
    return spark.createDataFrame(I.build_chain(df, ["host"], ["id"], COLUMNS).collect(), "host string, id long, ts string, message string, prev_hash string, hash string")


def problems(df, **more):
    return sorted((r.id, r.problem) for r in I.verify(df, ["host"], COLUMNS, **more).collect())


def test_build_and_tamper(spark):
    c = chain(spark)
    first = c.filter("id = 1").first()
    assert first.hash == hashlib.sha256(("0" * 64 + "\x1ft1\x1fm1").encode()).hexdigest()
    heads = I.chain_heads(c, ["host"])
    assert problems(c, heads=heads) == []
    assert problems(c.withColumn("message", F.when(F.col("id") == 4, "x").otherwise(F.col("message")))) == [(4, "content")]
    assert problems(c.filter("id <> 4")) == [(5, "gap"), (5, "link")]
    assert problems(c.filter("id > 2")) == [(3, "start")]
    assert problems(c.filter("id < 6")) == [] and problems(c.filter("id < 6"), heads=heads) == [(5, "head")]
    assert problems(c.limit(0)) == []


def test_prune_keeps_a_chain_that_verifies(spark):
    c = chain(spark).withColumn("us", F.when(F.col("id") == 2, 99).otherwise(F.col("id") * 10))
    b = I.retention_boundary(c, ["host"], 35)
    assert tuple(b.select("boundary").first()) == (3,)
    left = I.prune(c, b, ["host"])
    assert sorted(r.id for r in left.collect()) == [4, 5, 6]
    assert problems(left, anchors=b) == [] and problems(left) == [(4, "start")]


def test_blobs(spark):
    df = spark.createDataFrame([(b"a",), (b"a",), (b"bb",), (None,)], "d binary")
    blobs = I.put_blobs(df, "d")
    assert sorted((r.size, r.copies, bytes(r.data)) for r in blobs.collect()) == [(1, 2, b"a"), (2, 1, b"bb")]
    refs = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(),), (None,)], "r string")
    assert [r.size for r in I.unreferenced(blobs, [refs, refs.limit(0)]).collect()] == [2]


def test_baseline(spark):
    cols = "path string, sha256 string, size long, mtime long, mode int, uid long"
    b = spark.createDataFrame([("/a", "x", 1, 1, 0o644, 0), ("/b", "x", 1, 1, 0o644, 0), ("/c", None, 1, 1, 0o644, 0), ("/d", "x", 1, 1, 0o644, 0), ("/e", "x", 1, 1, 0o644, 0), ("/f", "x", 1, 1, None, None)], cols)
    c = spark.createDataFrame([("/a", "y", 1, 1, 0o644, 0), ("/c", None, 2, 1, 0o644, 0), ("/d", "x", 1, 9, 0o666, 0), ("/e", "x", 1, 1, 0o644, 5), ("/f", "x", 1, 1, None, None), ("/g", "x", 1, 1, 0o644, 0)], cols)
    got = {r.path: (r.change, r.severity) for r in I.compare_baseline(b, c).collect()}
    assert got == {"/a": ("modified", 0), "/b": ("deleted", 0), "/c": ("modified", 0), "/d": ("permissions_changed", 2), "/e": ("permissions_changed", 0), "/f": ("unchanged", 0), "/g": ("created", 0)}
    events = {r.target: (r.action, r.message) for r in I.file_events(I.compare_baseline(b, c)).collect()}
    assert len(events) == 6 and events["/b"] == ("file.deleted", "Deleted /b")


def test_content_policy(spark):
    f = spark.createDataFrame([("/a", b"password=hunter2\n", None), ("/b", b"\x00\x01", None), ("/c.key", b"text", None), ("/d", None, "/target"), ("/e", b"x" * 50, None)], "path string, data binary, link string")
    got = {r.path: (r.sha256 is not None, r.kept_text) for r in I.content_policy(f, ["*.key"], most_kept=40, most_hashed=45).collect()}
    assert got == {"/a": (True, "password=***\n"), "/b": (True, None), "/c.key": (True, None), "/d": (True, "-> /target\n"), "/e": (False, None)}


def test_diff_and_debounce(spark):
    p = spark.createDataFrame([("/a", "1\n2\n3\n", "1\nx\n3\n4\n"), ("/b", "", "n")], "path string, before string, after string")
    got = {r.path: (r.added, r.removed) for r in I.unified_diffs(p).collect()}
    assert got == {"/a": (2, 1), "/b": (1, 0)}
    n = spark.createDataFrame([("/a", k) for k in (0.0, 1.0, 2.2, 5.0)], "path string, s double").select("path", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    assert sorted(r.notices for r in I.debounced(n).collect()) == [1, 3]
