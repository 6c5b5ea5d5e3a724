"""Files, sinks, streams and what SQL does not reach."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphzone.functions import codes
from glyphzone.operators import layout, records, text
from glyphzone.operators.scan import find, mend_runs, mend_separator, mend_touching
from glyphzone.plans import documents, ops
from glyphzone.sources import files, labels
from glyphzone.streaming import jobs

#: A published specimen.
TD3 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_files(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "note.txt", "sub/c.webp", "scan.heic", "x.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    names = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert names(files.batch_inputs(spark, f"file://{tmp_path}")) == ["a.jpg", "b.PNG", "c.webp"]
    assert names(files.batch_inputs(spark, f"file://{tmp_path}/?.*")) == ["a.jpg", "b.PNG", "x.pdf"]
    with pytest.raises(FileNotFoundError):
        files.batch_inputs(spark, f"file://{tmp_path}/nothing*")
    d = files.binary_files(spark, f"file://{tmp_path}", images_only=False).where(F.col("path").endswith("note.txt"))
    want = hashlib.sha256(b"note.txt").hexdigest()
    assert d.select(files.verified(F.col("content"), f" {want.upper()}")).first()[0] and not d.select(files.verified(F.col("content"), "00")).first()[0]
    read = files.recognized(d, lambda b: b.decode().upper())
    assert read.first()["text"] == "NOTE.TXT" and files.page_texts(spark, f"file://{tmp_path}/note.txt").first()["text"] == "note.txt"
    paths = column(spark, ["a/b.HEIC", "x.pdf", "y.gif", "noext", "a.b/c"])
    assert [tuple(r) for r in paths.select(files.refusal(F.col("x")), files.looks_like_image(F.col("x"))).collect()] == [("unsupported_heic", False), ("unsupported_pdf", False), (None, True), (None, False), (None, False)]
    assert [r[0] for r in column(spark, ["a.p-n/g", "a.", "none", "a.b.JPG", "x.é"]).select(files.safe_extension(F.col("x"))).collect()] == ["png", "bin", "bin", "JPG", "bin"]
    target = f"file://{tmp_path}/model.bin"
    files.commit_verified(spark, target, b"good", hashlib.sha256(b"good").hexdigest())
    with pytest.raises(ValueError):
        files.commit_verified(spark, target, b"bad", hashlib.sha256(b"good").hexdigest())
    assert (tmp_path / "model.bin").read_bytes() == b"good" and not list(tmp_path.glob("*.part"))


def test_sinks(spark, tmp_path):
    key = ops.key_from_base64(" AAECAwQFBgcICQoLDA0ODxAREhMUFRYXGBkaGxwdHh8=\n")
    assert key == bytes(range(32))
    with pytest.raises(ValueError):
        ops.key_from_base64("AAAA")
    d = spark.createDataFrame([(1, '{"a":1}'), (2, None)], "k int, record string")
    documents.write_records(d, f"file://{tmp_path}/plain")
    documents.write_records(d, f"file://{tmp_path}/secret", key)
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/plain").collect()] == ['{"a":1}']
    blobs = spark.read.parquet(f"file://{tmp_path}/secret")
    assert [r["record"] for r in documents.decrypted(blobs, key).collect()] == ['{"a":1}'] and documents.decrypted(blobs, bytes(32)).first()["record"] is None
    log = f"file://{tmp_path}/audit"
    row = ops.audit(d.limit(1), F.lit(b"abc"), F.lit(5), F.lit("llm"), F.lit(None).cast("boolean"), F.lit("P"))
    ops.append_audit(row, log)
    ops.append_audit(row, log)
    assert [json.loads(r[0])["sha256"] for r in spark.read.text(log).collect()] == [hashlib.sha256(b"abc").hexdigest()] * 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.jpg", "b.txt", "c.webp"):
        (tmp_path / "in" / name).write_bytes(b"x")
    seen = jobs.run_to_end(jobs.watched(spark, f"file://{tmp_path}/in").select("path", "sha256"), "glyphzone_watched")
    assert sorted(r["path"][-6:] for r in seen.collect()) == ["/a.jpg", "c.webp"]
    events = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:05:00", "b", 3.0)]
    spark.createDataFrame(events, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"file://{tmp_path}/events")
    rows = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"file://{tmp_path}/events")
    got = jobs.run_to_end(jobs.counters(rows), "glyphzone_counters", "complete").collect()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in got) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_settings():
    assert [ops.positive_or(x, 100) for x in (None, "", "0", "-3", "7", "+8", "x", "٣")] == [100, 100, 100, 100, 7, 8, 100, 100]


def test_codes(spark):
    names = {c: n for _, c, n in codes.codes(spark)}
    assert len(names) == 231 and names["XCC"] == "Caribbean Community (CARICOM)" and names["CIV"] == "Côte d'Ivoire" and "GUM" not in names
    d = codes.with_code(column(spark, ["kosovo", "GERMANY", "TÜRKIYE", "türkiye", "Türkiye"]), "x", "code", codes.code_table(spark)).collect()
    assert {r["x"]: r["code"] for r in d} == {"kosovo": "XKX", "GERMANY": "DEU", "TÜRKIYE": None, "türkiye": "TUR", "Türkiye": "TUR"}


def test_otsu_and_boxes(spark):
    r = np.random.default_rng(2)
    histograms = [r.integers(0, 50, 256).tolist(), [0] * 256, [0] * 10 + [5] + [0] * 200 + [9] + [0] * 44]
    got = [x[0] for x in column(spark, histograms, "array<long>").select(layout.otsu(F.col("x"))).collect()]

    def brute(h):
        best, at, n = -1.0, 0, sum(h)
        for t in range(256):
            a, b = h[: t + 1], h[t + 1 :]
            if sum(a) and sum(b):
                ma, mb = sum(i * c for i, c in enumerate(a)) / sum(a), sum((i + t + 1) * c for i, c in enumerate(b)) / sum(b)
                if (v := sum(a) * sum(b) * (ma - mb) ** 2) > best * (1 + 1e-12):
                    best, at = v, t
        return at if n else 0

    assert got == [brute(h) for h in histograms]
    boxes = spark.createDataFrame([((-3.5, 2.9, 10.2, 0.5),), (None,)], "b struct<x:double,y:double,w:double,h:double>")
    assert [r[0] and tuple(r[0]) for r in boxes.select(records.portrait_ref(F.col("b"))).collect()] == [(0, 2, 10, 0), None]
    assert spark.range(1).select(layout.union(F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))).first()[0] is None
    lines = "array<struct<text:string,bbox:struct<x:double,y:double,w:double,h:double>>>"
    page = spark.createDataFrame([([("TITLE", (0.0, 0.0, 50.0, 10.0)), *((t, (5.0, 100.0 + 20 * i, 44 * 6.2, 10.0)) for i, t in enumerate(TD3.split("\n")))],), ([],), ([("only", (0.0, 0.0, 1.0, 1.0))],)], f"x {lines}")
    found = [r[0] for r in page.select(layout.band(F.col("x"))).collect()]
    assert found[0]["score"] == pytest.approx(1) and found[0]["bbox"]["y"] == 100 and found[0]["bbox"]["h"] == 30 and found[1:] == [None, None]


def test_text_edges(spark):
    d = column(spark, ["a|b = c\n证件样本 x\n\nok\n", "", None])
    assert [r[0] for r in d.select(text.drop_noise(F.col("x"))).collect()] == ["a|b = c\n\nok", "", None]
    assert text.grammar(("a", "b")).startswith('root ::= "{" ws "\\"a\\"" ws ":" ws value ws "," ws "\\"b\\"" ws ":" ws value ws "}"\n')


def test_filler_repairs():
    """Fillers that were read as K or L, in the places where a zone has them."""
    assert mend_runs("ERIKSSONKK<KLL") == "ERIKSSON<<<<<<" and mend_runs("KLM") == "KLM" and mend_runs("LARK<<<<") == "LARK<<<<"
    assert mend_touching("ZE1<KK<LA") == "ZE1<<<<<A" and mend_separator("ERIKSSONKKANNA<<<") == "ERIKSSON<<ANNA<<<" and mend_separator("AKKB<<C") == "AKKB<<C"
    one, two = TD3.split("\n")
    noisy = [one.replace("MARIA" + "<" * 19, "MARIA" + "<K<<KKL<<<KKK<<L<<<"), one[:1] + "K" + one[2:], one.replace("ERIKSSON<<", "ERIKSSONKK")]
    for line in noisy:
        fields, checks = find(f"x\n{line}\n{two.replace('B<<<<<10', 'BKK<LL10')}")
        assert all(checks) and fields["surname"] == "ERIKSSON" and fields["given_names"].startswith("ANNA MARIA") and fields["document_number"] == "L898902C3", line
    for i, c in ((9, "G"), (13, "T"), (14, "A")):
        swapped = two[:i] + {"G": "G", "T": "T", "A": "A"}[c] + two[i + 1 :]
        got = find(f"{one}\n{swapped}")
        assert got and (all(got[1]) == (c == "G"))  # G reads as 6, which is this digit; T and A read as nothing


def test_seeded_identities_repeat(spark):
    one, two = (labels.seeded(spark, 7, 50).collect() for _ in range(2))
    assert one == two and len({r["document_number"] for r in one}) == 50 and all(1950 <= r["birth"].year <= 2008 <= 2027 <= r["expiry"].year <= 2036 for r in one)


def test_validity_on_the_day_itself(spark, tmp_path):
    """A document that expires today is in date, one of the day before is not: of the keys here 1469 ends on 2030-01-02, 1192 a day before."""
    import duckdb

    from glyphzone.plans.queries import ORACLES, QUERIES

    spark.range(3000).selectExpr("id as c_custkey", "'X' as c_mktsegment", "0 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = dict(c.execute(ORACLES["validity_all_ok"]).fetchall())
    got = {r["k"]: r["ok"] for r in QUERIES["validity_all_ok"](spark, str(tmp_path)).collect()}
    assert got == want


def test_fields_with_holes(spark):
    """Candidates are those of all fillings that the check digit and the rule accept, and made without trying each one."""
    import itertools
    import time

    from glyphzone.functions.layouts import ALPHABET
    from glyphzone.operators import repair
    from glyphzone.operators.scan import right

    texts = ["??0012345", "?A?<<<<<<", "L8989?2C3", "7?081?", "740812", "?", "??", "A?B?C?", "", None, "é?", "a?", "?<<<<A"]
    rows = [(f"{i},{check},{kind}", t, check, kind) for i, t in enumerate(texts) for check in ("6", "<", "A", None) for kind in ("document_number", "date", "other")]

    def brute(t, check, kind):
        if t is None or check is None or t.count("?") > 2:
            return []
        fills = {"".join(c or x for c, x in zip(f, t, strict=True)) for f in itertools.product(*(ALPHABET if x == "?" else "\0" for x in t))}
        fills = {"".join(x if c == "\0" else c for c, x in zip(f, t, strict=True)) for f in fills} if t else {""}
        fits = [f for f in fills if set(f) <= set(ALPHABET) and right(f, check)]
        if kind == "document_number":
            fits = [f for f in fits if "<" not in f.rstrip("<")]
        if kind == "date":
            import datetime

            def real(f):
                try:
                    return len(f) == 6 and f.isdigit() and any(datetime.date(c + int(f[:2]), int(f[2:4]), int(f[4:])) for c in (2000,) if f[2:] != "0229" or int(f[:2]) % 4 == 0)
                except ValueError:
                    return False

            fits = [f for f in fits if real(f)]
        return sorted(fits)

    got = repair.solve_field(spark.createDataFrame(rows, "k string, field string, check string, kind string"), "k")
    assert {r["k"]: r["candidates"] for r in got.collect()} == {k: brute(*rest) for k, *rest in rows}
    many = spark.range(20_000).selectExpr("id as k", "'??0012345' as field", "'6' as check", "'document_number' as kind").repartition(8)
    began = time.time()
    assert repair.solve_field(many, "k").selectExpr("sum(size(candidates)) as n").first()["n"] == 20_000 * len(brute("??0012345", "6", "document_number"))
    assert time.time() - began < 15


def test_answers_are_parsed_once(spark):
    """A model's answer is parsed to see if it needs mending and once for all fields, not for each of them."""
    answers = ['{"document_number": "N1", "surname": null,}', "```json\n{\"sex\": \"F\"}\n```", "sorry", "[1]", '{"sex": 1}', "", None]
    d = column(spark, answers).select(text.parse_extraction(F.col("x")).alias("e"))
    got = [(r["e"]["document_number"], r["e"]["sex"], r["e"]["extraction_method"], r["e"]["error"]) for r in d.collect()]
    bad = [(None, None, None, e) for e in ("invalid_json", "not_an_object", "wrong_type", "invalid_json", "invalid_json")]
    assert got == [("N1", None, "llm", None), (None, "F", "llm", None), *bad]
    assert d._jdf.queryExecution().analyzed().toString().count("parse_json") <= 4
