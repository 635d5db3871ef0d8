import hashlib

from pyspark.sql import functions as F

from twinspark.functions import scalars
from twinspark.functions.blake3 import Blake3, blake3, blake3_hex, blake3_many, joined

#: Digests of the official test pattern (byte i is i mod 251), by length.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    64: "4eed7141ea4a5cd4b788606bd23f46e212af9cacebacdc7d1f4c6dc7f2511b98", 65: "de1e5fa0be70df6d2be8fffd0e99ceaa8eb6e8c93a63f2d8d1c30ecb6b263dee",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 3073: "7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3",
    7168: "61da957ec2499a95d6b8023e2b0e604ec7f6b50e80a9678b89d2628e99ada77a", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_blake3(spark):
    patterns = [bytes(i % 251 for i in range(n)) for n in VECTORS]
    assert [d.hex() for d in blake3_many(patterns)] == list(VECTORS.values())
    assert all(blake3(p).hex() == h for p, h in zip(patterns, VECTORS.values()))
    df = spark.createDataFrame([(0, patterns[3]), (1, None), (2, b"")], "i int, content binary")
    assert [r[0] for r in df.orderBy("i").select(blake3_hex("content")).collect()] == [VECTORS[65], None, VECTORS[0]]


def test_blake3_piece_by_piece(monkeypatch):
    monkeypatch.setattr(Blake3, "PIECE", 4096)
    data = bytes(i % 251 for i in range(102_400))
    for n, want in VECTORS.items():
        for step in (1000, 4096, 50_000):
            state = Blake3()
            for at in range(0, n, step):
                state.update(data[at : min(at + step, n)])
            assert state.value().hex() == want and len(state.stack) <= 6
    for n in (0, 1, 4096, 4097, 8192, 12_288, 12_289, 40_000, 65_536, 102_400):
        for size in (4096, 16_384):
            starts = range(0, max(n, 1), size)
            parts = [Blake3(at).update(data[at : min(at + size, n)]).value(root=len(starts) == 1) for at in starts]
            assert joined(parts) == blake3(data[:n]), (n, size)


def test_scalars(spark):
    row = one(
        spark, scalars.quoted_path(F.lit('a"b\\c\x01\x7fé')).alias("q"), scalars.normal_path(F.lit("/a/../../b//c/.")).alias("n"), scalars.normal_path(F.lit("../a/..")).alias("m"), scalars.safe_relative(F.lit("a/../b")).alias("s"),
        scalars.fnv1a_64(F.lit("")).cast("string").alias("f0"), scalars.fnv1a_64(F.lit("foobar")).cast("string").alias("f6"), scalars.truncated_utf8(F.lit("aéé"), 5).alias("t"), scalars.truncated_utf8(F.lit("ab"), 3).alias("u"),
        scalars.from_big_endian(scalars.big_endian(F.lit(258))).alias("be"), F.hex(scalars.big_endian(F.lit(258))).alias("bx"), scalars.learning_key(F.lit("ab"), F.lit("é")).alias("k"), scalars.utc_time(F.lit(1_000_000_000_000)).cast("string").alias("time"),
        F.length(scalars.run_id()).alias("r"), F.length(scalars.source_id(F.lit("/x"))).alias("sid"), scalars.throughput_mib(F.lit(1048576), F.lit(0.5)).alias("mib"), scalars.throughput_mib(F.lit(1), F.lit(0.0)).alias("none"),
    )
    assert row.q == '"a\\"b\\\\c\\u0001\\u007fé"' and row.n == "/b/c" and row.m == ".." and not row.s
    assert row.f0 == "14695981039346656037" and row.f6 == str(0x85944171F73967E8)
    assert tuple(row.t) == ("aé", True) and tuple(row.u) == ("ab", False)
    assert row.be == 258 and row.bx == "0000000000000102" and row.k == "2:ab2:é" and row.time == "1970-01-01 00:16:40"
    assert row.r == 32 and row.sid == 19 and row.mib == 2 and row.none == 0


def test_bands_and_units(spark):
    sizes = [1, 1023, 1024, 4095, 4096, (1 << 48) - 1, 1 << 48]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    assert [r[0] for r in df.select(scalars.size_band(F.col("s"))).collect()] == [(s.bit_length() - 1) // 2 for s in sizes]
    units = {0: "0 B", 1023: "1023.00 B", 1024: "1.00 KiB", 1152: "1.12 KiB", 1 << 60: "1.00 EiB"}
    got = spark.createDataFrame([(s,) for s in units], "s long").select("s", scalars.human_bytes(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in got} == units
    times = {0.0: "0 ms", 0.0005: "500.00 ns", 0.5: "500.00 us", 999.0: "999.00 ms", 1500.0: "1.50 s", 90_000.0: "1.50 min", 7_200_000.0: "2.00 h"}
    got = spark.createDataFrame([(s,) for s in times], "s double").select("s", scalars.human_duration(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in got} == times
    ms = [0.0019, 0.002, 0.0039, 0.004, 2147483.648]
    got = spark.createDataFrame([(s,) for s in ms], "s double").select(scalars.latency_bucket(F.col("s"))).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2, 31]
    assert hashlib.sha256(b"").hexdigest() == one(spark, scalars.hex_digest(F.unhex(F.sha2(F.lit(""), 256))).alias("h")).h
