"""Odd rows through every stage and operator, and results of operators 1, 6 and 10 against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, neardup, pieces, quality, secrets, surrogates, wordpiece

WORDS = "the river runs past old mills where people once ground their grain and sold flour to travelling merchants in spring".split()


def say(rnd, k):
    return " ".join(rnd.choice(WORDS) for _ in range(k))


def odd_rows():
    rnd = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (3, "one"), (3, "another text of this id"), (None, say(rnd, 30)), (None, None), (4, "x" * 50_000), (5, (say(rnd, 12) + ". ") * 400)]
    base = say(rnd, 60)
    rows += [(10 + i, base + (" end" if i % 2 else "")) for i in range(6)] + [(20 + i, say(rnd, rnd.randrange(1, 80))) for i in range(30)]
    return rows + [(60, "password = hunter2hunter2 " + say(rnd, 20)), (61, "Mr. John Smith wrote to a.b@example.org. Smith is well."), (62, say(rnd, 5) + " planted words of the benchmark item stand right here now ok " + say(rnd, 5))]


CLASHING = "_id long, _hash long, _new string, _draws string, _draws_id long, _pieces int, row int, key string, node long, window long, salt int"


def frame(spark, rows):
    extra = (1, 2, "n", "d", 3, 4, 5, "k", 6, 7, 8)
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), *extra) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "empty"])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    import corpus_pipeline

    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, 0) for d, t in rows if d is not None and t][:20] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "planted words of the benchmark item stand right here now"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert (now.columns == columns) if i + 1 < len(corpus_pipeline.STAGES) else set(columns) < set(now.columns)
        assert all((r["_id"], r["_new"], r["key"]) == (1, "n", "k") for r in now.collect())
    out = now.collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} <= {d for d, _ in rows}
    if rows:
        ids = [r.doc_id for r in out]
        assert 62 not in ids and 60 in ids and 11 not in ids and 10 in ids and None in ids
        assert "hunter2" not in next(r.text for r in out if r.doc_id == 60)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)


@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "empty"])
def test_operators_take_odd_rows(spark, rows):
    df = frame(spark, rows)
    one = lambda made: made.count() == len(rows)
    assert one(secrets.secret_spans(df)) and one(wordpiece.token_counts(df)) and one(pieces.encode_rows(df)) and one(surrogates.replace_private(df, b"k")) and one(neardup.near_duplicates(df))
    model = quality.fit_ratings(df, spark.createDataFrame([(20, 1), (21, 0)], "doc_id long, grade int"), 3)
    assert one(quality.score(df, model))
    back = pieces.decode_column(pieces.encode_column(df, checked_col="same"), out_col="back").collect()
    assert all(r.same and r.back == r.text for r in back)


def test_encoding_by_the_plain_recurrence():
    made = pieces.Encoder(*pieces.load_pieces())
    table = {p: s for p, s, k in zip(made.pieces, made.scores, made.kinds, strict=True) if k == 0}
    rnd = random.Random(3)
    letters = "abcdeghinorstuéßя漢"
    for _ in range(150):
        unit = "▁" * rnd.randrange(2) + "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14)))
        best = [0.0] + [float("-inf")] * len(unit)
        for j in range(1, len(unit) + 1):
            whole = [best[i] + table[unit[i:j]] for i in range(j) if unit[i:j] in table]
            best[j] = max(whole + ([best[j - 1] + made.byte_score * len(unit[j - 1].encode())] if unit[j - 1] not in table else []))
        ids = np.frombuffer(made.encode_units([unit])[0], "<i4")
        assert sum(made.scores[i] if made.kinds[i] == 0 else made.byte_score for i in ids) == pytest.approx(best[-1])


def test_secrets_in_prose_are_told_from_prose():
    """Keys of real formats planted in prose, and tokens that prose and code really hold: neither comes from the generator of the models' samples."""
    rnd = random.Random(21)
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["sk_live_" + "".join(rnd.choices(base, k=32)) for _ in range(40)] + ["ghp_" + "".join(rnd.choices(base, k=36)) for _ in range(40)] + ["eyJ" + "".join(rnd.choices(base + "-_", k=60)) for _ in range(40)] + ["xoxb-" + "".join(rnd.choices("0123456789", k=12)) + "-" + "".join(rnd.choices(base, k=24)) for _ in range(40)] + ["".join(rnd.choices(hexes, k=40)) for _ in range(40)]
    plain = "internationalization counterrevolutionaries pneumonoultramicroscopicsilicovolcanoconiosis get_user_name_from_request AbstractSingletonProxyFactoryBean org/apache/spark/sql/catalyst Donaudampfschifffahrtsgesellschaft anticonstitutionnellement https-everywhere-extension-store maxRecordsPerOutputBatch enable_adaptive_execution_by_default src/main/resources/application README-for-contributors-and-users otorrinolaringologia-especializada".split()
    model = secrets.MarkovPair.fit(secrets.labelled_samples())
    token = secrets._token(20)
    caught = missed = wrong = 0
    for k in keys:
        t = f"{say(rnd, 12)} {k} {say(rnd, 12)}"
        spans = secrets.all_spans(t, model, secrets.base_spans(t), 20, 0.9, token)
        at = t.index(k)
        hit = any(a < at + len(k) and at < b for a, _, b in spans)
        caught, missed = caught + hit, missed + (not hit)
        wrong += sum(not (a < at + len(k) and at < b) for a, _, b in spans)
    for w in plain:
        t = f"{say(rnd, 12)} {w} {say(rnd, 12)}"
        wrong += len(secrets.all_spans(t, model, secrets.base_spans(t), 20, 0.9, token))
    assert caught >= 0.95 * len(keys) and wrong <= 1, (caught, missed, wrong)


def test_spans_of_a_long_text_by_brute_force():
    rnd = random.Random(5)
    model = secrets.MarkovPair.fit(secrets.labelled_samples())
    parts = ["secret=abcdef12", "A1b2C3d4E5f6G7h8I9j0K1", "deadbeef" * 4, "plain", "AKIA" + "Z9" * 10, "internationalization-of-words"]
    text = "".join(rnd.choice(parts) + rnd.choice([" ", "", "é"]) for _ in range(600))
    base, token = secrets.base_spans(text), secrets._token(20)
    free = [m.span() for m in token.finditer(text) if not any(m.start() < e and s < m.end() for s, _, e in base)]
    want = sorted(base + [(a, 3, b) for a, b in free if model.scores([text[a:b]])[0] > 0.9])
    assert secrets.all_spans(text, model, base, 20, 0.9, token) == want and any(k == 3 for _, k, _ in want)


def test_surrogates_by_brute_force(spark):
    key = b"k"
    rows = [(1, "Mr. John Smith and Dr. Lee met. Smith left; LEE stayed."), (2, "Mrs. Smith, a.b@c.org, +1 555 010 9999"), (3, "г-жа Анна Петрова и г-н Петров; Петрова ушла. Иванов остался"), (4, "κύριος Παπαδόπουλος, Παπαδόπουλος"), (5, "Mr. 王小明 said 王小明"), (6, "a smith and a lee, no names"), (7, None), (1, "Mr. John Smith again")]
    got = surrogates.replace_private(frame(spark, rows), key).collect()
    plain = {(d, t): surrogates_of(t, key) for d, t in rows}
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((d, new) for (d, _), new in plain.items()), key=repr)
    spans = {(d, new): ",".join(f"{k}:{a}:{b}" for a, b, k, _ in surrogates.find(t or "")) for (d, t), new in plain.items()}
    assert all(r.private_spans == spans[r.doc_id, r.text] for r in got)
    by = {(r.doc_id, len(r.private_spans or "")): r.text for r in got}
    out = " ".join(t for t in by.values() if t)
    assert not re.search(r"Smith|SMITH|\bLee\b|LEE|Петров|Παπαδ|王小明|a\.b@c\.org|010 9999", out) and "a smith and a lee, no names" in out and "Иванов остался" in out
    petrova = re.search(r"г-жа [А-Я][а-я-А-Я]* ([А-Я][а-я]+) и г-н ([А-Я][а-я]+); ([А-Я][а-я]+) ушла", out)
    assert petrova[1] == petrova[3] == petrova[2] + "а"
    greek, han = re.search(r"κύριος (\w+), (\w+)", out), re.search(r"Mr\. (\w+) said (\w+)", out)
    assert greek[1] == greek[2] and surrogates.script_of(greek[1]) == "greek" and han[1] == han[2] and surrogates.script_of(han[1]) == "cjk"


def surrogates_of(text, key):
    out, at = [], 0
    for a, b, kind, canonical in surrogates.find(text or ""):
        out += [text[at:a], surrogates.shaped(text[a:b], kind, surrogates.draw(key, kind, canonical, 0))]
        at = b
    return text if not out else "".join(out) + text[at:]


def test_finding_is_one_pass_in_order():
    rnd = random.Random(2)
    parts = ["a.b@c.org", "+1 555 010 9999", "10.0.0.1", "078-05-1120", "4111 1111 1111 1111", "Mr. Bo Li", "words", "GB82 WEST 1234 5698 7654 32"]
    for _ in range(200):
        t = " ".join(rnd.choices(parts, k=rnd.randrange(1, 12)))
        found = surrogates.find(t)
        assert found == sorted(found) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False)) and all(t[a:b].strip() for a, b, _, _ in found)


def test_grades_by_the_plain_formula(spark):
    rnd = random.Random(4)
    rows = [(i, say(rnd, 40) + (" great" * (i % 3 == 2)) + (" awful" * (i % 3 == 0)) + " " + "w" * 90 + str(i)) for i in range(120)]
    df = frame(spark, rows)
    model = quality.fit_ratings(df, spark.createDataFrame([(i, i % 3) for i in range(90)], "doc_id long, grade int"), 3)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    for d, t in rows:
        words = t.encode().split()
        shape = lambda w: re.sub(rb"(.)\1+", rb"\1", w.translate(quality._SHAPE), flags=re.S)
        shapes = [shape(w) for w in words]
        import zlib

        mask = (1 << quality.BITS) - 1
        index = {zlib.crc32(w.lower()) & mask for w in words} | {zlib.crc32(b"\0%d " % min(5, int(6 * shapes.count(s) / len(words))) + s) & mask for s in set(shapes)}
        s = sum(float(model.weights[i]) for i in index)
        tails = [1 / (1 + np.exp(c - s)) for c in model.thresholds]
        assert got[d].score == pytest.approx(s, abs=1e-5) and got[d].tails == pytest.approx(tails, abs=1e-5) and got[d].expected_grade == pytest.approx(sum(tails), abs=1e-5)
    kept = {r.doc_id for r in quality.keep_good(df, model, 2).collect()}
    assert kept == {d for d in got if got[d].tails[1] >= quality.KEEP_FROM}


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("s"), F.array(F.lit(1), F.lit(2)).alias("a"))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small(df)) and not hinted(common.small(df, most=500)) and not hinted(common.small(df, rows=5))
