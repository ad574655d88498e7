"""Column functions, readers, sinks, mixtures and streams on fixtures, against plain Python."""

import hashlib
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import evals, scoring, text, urls
from corpusloom.operators import conversations, dedup, hamming, leakage, metrics, mixture, outcomes
from corpusloom.plans import curation, registry
from corpusloom.plans.scratch import cutter
from corpusloom.sources import readers, sinks
from corpusloom.streaming import packing

ODD = ["Café — “x” ‘y’ ‑z­ \r\n\r\n\r\n\r\n\r\n a\tb c", " one\u0085two\x1cthree", "", "  ", "ӓ Ўі’ʼ'", "�x 😀\U000f0000"]


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first()[0]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t")).alias("r")).collect()]


def test_canonical_forms(spark):
    control = lambda t: "".join(" " if c not in "\t\n" and unicodedata.category(c)[0] == "C" else c for c in t)

    def flat(t):
        t = unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n"))
        t = control(t.translate(str.maketrans("‐‑‒–−‘’ʼ“”", "-----’’’\"\"")))
        return re.sub(r"\s+", " ", t).strip()

    assert column(spark, ODD, lambda c: text.normalized(c, False)) == [flat(t) for t in ODD]
    assert column(spark, ODD, text.canonical) == [re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).translate(str.maketrans("'ʼ‘", "’’’"))).strip() for t in ODD]
    assert column(spark, ODD, text.words) == [re.findall(r"\w+", unicodedata.normalize("NFC", t).lower()) for t in ODD]
    assert column(spark, ODD, text.digest) == [hashlib.sha256(" ".join(re.findall(r"\w+", unicodedata.normalize("NFC", t).lower())).encode()).hexdigest() for t in ODD]
    kept = column(spark, ["a  b\n\n\n\n\n c \n"], text.normalized)[0]
    assert kept == "a b\n\n\nc"


def test_lines_and_grams(spark):
    assert column(spark, ["a\n \nb\x0bc"], text.lines) == [["a", "b", "c"]]
    assert column(spark, ["a b c d", "a"], lambda c: text.ngrams(text.words(c), 3)) == [["a b c", "b c d"], []]
    assert column(spark, ["a b c d e"], lambda c: text.windows(text.words(c), 2, 2)) == [[["a", "b"], ["c", "d"], ["e"]]]
    assert column(spark, ["x\n" * 12, "x\n" * 5], text.repeated_lines) == [True, False]
    assert column(spark, ["aa\n\nbbbb\n\ncc\n\nd"], lambda c: text.chunks(c, 3, 6)) == [["aa\n\nbbbb", "cc\n\nd"]]


def test_markup(spark):
    assert one(spark, text.strip_wikitext, "'''A''' [[b|c]] [[d]] {{x|{{y}}}}<ref>z</ref>\n== H ==") == "A c d\nH"
    assert one(spark, text.strip_html, "<p>a &amp; b<script>x</script></p>") == "a & b"
    assert column(spark, ["{{a|b}} {{c}}", "{{a|{{b|c}}", "no"], text.template_chars) == [7, 11, 0]
    assert one(spark, lambda c: text.substitute(c, {"foo bar": "X", "foo": "Y"}), "Foo bar, foo foobar") == "X, Y foobar"
    assert one(spark, lambda c: text.family(c, ("please ",), (r",? thanks",)), "Please please Say HI, thanks") == "say hi"


def test_urls(spark):
    u = ["https://www.Ex.com/A/b/?x=1#f", "http://u@h.com/", "ftp://a", "", None, "http://sub.bad.org/tag/x", "http://m.site.com/?lang=fr"]
    assert column(spark, u, urls.host)[:2] == ["ex.com", "h.com"]
    assert column(spark, u, urls.is_valid) == [True, False, False, False, False, True, True]
    assert column(spark, u, urls.family_form)[0] == "//www.ex.com/A/b"
    assert column(spark, u, lambda c: urls.problem(c, ["bad.org"], ["tag"]))[5] == "domain_requires_quality_review"
    assert column(spark, u, lambda c: urls.route(c, ["fr"])) == [False, False, False, False, False, False, True]


def test_scores(spark):
    p = scoring.LanguageProfile("А-Яа-яЁёІіЎў", "A-Za-z", "ўі", frozenset(["гэта", "мова", "для"]), frozenset(["это", "язык", "который"]))
    texts = ["Гэта беларуская мова і ўсе словы для тэста тут.", "Это русский язык " * 20, "only english words here and nothing else at all", None]
    got = column(spark, texts, lambda c: scoring.detect(c, p))
    assert got[0].decision == "accept" and got[1].decision == got[2].decision == got[3].decision == "reject"
    assert "marker_letters" in got[0].reasons and "low_own_script" in got[2].reasons
    assert column(spark, texts, lambda c: scoring.web_problem(c, p))[:3] == [None, "rival_segments", "foreign_script_dominant"]
    assert column(spark, ["a b " * 100, "longer words here " * 60], scoring.fragmented) == [True, False]


def test_outcomes(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", "yy", "short"), ("b", "z", None)], "source string, text string, reason string")
    kept, ledger = outcomes.split_decisions(df)
    assert outcomes.assert_balanced(df, kept, ledger) == 3
    with pytest.raises(ValueError, match="accounted"):
        outcomes.assert_balanced(df, kept)


def test_hamming_and_simhash(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base] + [rnd.getrandbits(64) for _ in range(30)]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {(r.a, r.b) for r in dedup.hamming_pairs(spark.createDataFrame(rows, "id long, fp long"), "id", "fp").collect()}
    classes = {}
    for i, f in enumerate(fps):
        classes.setdefault(f, i)
    ids = sorted(classes.values())
    assert got == {(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 6}

    def simhash(t):
        votes = [0] * 64
        for w in re.findall(r"\w+", t.lower()):
            if len(w) >= 3:
                h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
                for i in range(64):
                    votes[i] += 1 if h >> i & 1 else -1
        out = sum(1 << i for i in range(64) if votes[i] > 0)
        return out - (1 << 64) if out >> 63 else out

    texts = ["some words that vote for bits", "été größe und mehr", "", "aa b"]
    assert column(spark, texts, dedup.simhash) == [simhash(t) for t in texts]


def test_simhash_pairs_of_all_rows(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for i in range(60):
        w = [f"word{rnd.randrange(10**6)}" for _ in range(40)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, ", ".join(reversed(w)).upper())][: 2 if i % 2 else 1] + [(3 * i + 2, " ".join([*w[1:], "other"]))]
    rows += [(300, None), (301, ""), (302, "aa b")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["simhash_pairs"](spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in out}
    prints = dict(zip((i for i, _ in rows), (x & (1 << 64) - 1 for x in column(spark, [t for _, t in rows], dedup.simhash)), strict=True))
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    # every row comes once, and no link between any two rows is lost
    want = {i: (first[f], sum(j != i and (f ^ g).bit_count() <= 6 for j, g in prints.items())) for i, f in prints.items()}
    assert got == want and len(out) == len(rows) and got[302] == (300, 2) and got[4][0] == 3 and max(n for _, n in got.values()) > 1


def clustered(rnd, n):
    """Distinct fingerprints: some around few centres, the others anywhere."""
    centres = [rnd.getrandbits(64) for _ in range(3)]
    return list(dict.fromkeys(rnd.choice(centres) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & (1 << 64) - 1 if i % 4 else rnd.getrandbits(64) for i in range(n)))


def test_links_and_choice_of_clustered_fingerprints(spark, monkeypatch):
    rnd = random.Random(11)
    fps = clustered(rnd, 900)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    rows += [(len(fps) + k, rows[k][1]) for k in range(0, 60, 3)]
    of = dict(rows)
    near = {f: sum(((f ^ g) & (1 << 64) - 1).bit_count() <= 6 for g in of.values()) - 1 for f in of.values()}
    kept = []
    for i, f in enumerate(fps):
        if all((f ^ g).bit_count() > 6 for _, g in kept):
            kept.append((i, f))
    cut, df = cutter(spark), spark.createDataFrame(rows, "id long, fp long")
    for block, blocks in ((10_000, 1), (40, 64)):  # one cell for a value of a band, and many
        monkeypatch.setattr(hamming, "BLOCK", block), monkeypatch.setattr(hamming, "BLOCKS", blocks)
        got = {r.id: r.n_links for r in hamming.hamming_links(df, "id", "fp", 6, cut).collect()}
        assert got == {i: near[f] for i, f in rows} and sum(got.values()) > 5000
    for alone in (10_000, 100, 0):  # by one task, after rounds, and by rounds alone
        got = hamming.kept_in_order(df.filter(f"id < {len(fps)}"), 6, cut, alone)
        assert sorted(r.id for r in got.collect()) == [i for i, _ in kept]


def test_first_independent_set(spark):
    rnd = random.Random(3)
    for _ in range(3):
        n = 25
        edges = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(30)})
        kept = []
        for i in range(n):
            if not any((j, i) in edges for j in kept):
                kept.append(i)
        got = dedup.first_independent(spark.range(n), spark.createDataFrame(edges, "a long, b long"), cutter(spark))
        assert sorted(r.id for r in got.filter("kept").collect()) == kept


def test_first_independent_set_in_rounds_and_on_a_long_chain(spark):
    rnd = random.Random(7)
    edges = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)})
    kept = []
    for i in range(40):
        if not any((j, i) in edges for j in kept):
            kept.append(i)
    for alone in (0, 20):
        got = dedup.first_independent(spark.range(40), spark.createDataFrame(edges, "a long, b long"), cutter(spark), alone=alone)
        assert sorted(r.id for r in got.filter("kept").collect()) == kept
    chain = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = dedup.first_independent(spark.range(1002), chain, cutter(spark))
    assert sorted(r.id for r in got.filter("kept").collect()) == [*range(0, 1001, 2), 1001]


def near_duplicates_fixture():
    """A chain in which only neighbours are similar, copies of its members in other letter case, short texts, and texts of their own."""
    word = [f"w{i}" for i in range(2000)]
    rows = [(2 * i, " ".join(word[7 * i : 7 * i + 100])) for i in range(230)]
    rows += [(2 * i + 1, t.upper() + "!") for i, (_, t) in enumerate(rows) if i % 3 == 0]
    rows += [(900 + i, rows[i][1].replace(" ", ", ")) for i in (0, 1, 5, 5)]
    return [*dict(rows).items(), (950, "too short"), (951, "Too short"), (952, None), (953, "")]


def brute_shingles(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        grams = frozenset(" ".join(w[j : j + 5]) for j in range(len(w) - 4))
        if len(grams) >= 20:
            sets[i] = grams
    return sets


def test_near_dup_kept_against_greedy(spark, tmp_path):
    rows = near_duplicates_fixture()
    sets, kept = brute_shingles(rows), []
    for i in sorted(sets):
        if not any(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in kept):
            kept.append(i)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept for r in registry.QUERIES["near_dup_kept"](spark, str(tmp_path)).collect()}
    assert got == {i: i not in sets or i in kept for i, _ in rows}


def test_shingle_links_of_all_documents(spark, tmp_path):
    rows = near_duplicates_fixture()
    sets, first = brute_shingles(rows), {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(first[s], i): 1.0 for i, s in sets.items() if first[s] != i}
    for x, a in first.items():
        for y, b in first.items():
            if a < b and 100 * len(x & y) >= 85 * len(x | y):
                want[a, b] = round(len(x & y) / len(x | y), 9)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.QUERIES["shingle_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want and 1.0 in want.values()
    counts = {}
    for j in want.values():
        counts[round(j, 2)] = counts.get(round(j, 2), 0) + 1
    assert dict(map(tuple, registry.QUERIES["similarity_histogram"](spark, str(tmp_path)).collect())) == counts


def test_caps_and_splits(spark):
    rnd = random.Random(4)
    groups = [(f"g{i}", f"s{i % 4}", None, rnd.randrange(1, 500)) for i in range(200)]
    df = spark.createDataFrame(groups, "group_id string, source string, orthography string, chars long")
    order = lambda g: hashlib.sha256(f"mixture\0{g}".encode()).hexdigest()
    other = sum(c for _, s, _, c in groups if s != "s1")
    used, want = 0, set()
    for g, s, _, c in sorted(groups, key=lambda x: order(x[0])):
        if s != "s1":
            want.add(g)
        elif used + c <= other * 0.1 / 0.9:
            used += c
            want.add(g)
    assert {r.group_id for r in mixture.capped(df, F.col("source") == "s1", 0.1).filter("kept").collect()} == want
    val = set()
    for s in {x[1] for x in groups}:
        mine = sorted((x[0] for x in groups if x[1] == s), key=order)
        val |= set(mine[: max(1, min(len(mine) - 1, round(len(mine) * 0.05)))])
    assert {r.group_id for r in mixture.stratified_split(df, 0.05).filter("split = 'val'").collect()} == val
    assert column(spark, ["a", "b"], lambda c: mixture.group_split(c, 1.0, "s")) == ["val", "val"]


def test_leakage(spark):
    prompts = spark.createDataFrame([(1, "too short"), (2, "this one has exactly six words"), (3, " ".join(f"w{i}" for i in range(30)))], "p long, text string")
    docs = spark.createDataFrame([(1, "it is too short here"), (2, "Too, short!"), (3, "so this one has exactly six words ok"), (4, "x " + " ".join(f"w{i}" for i in range(5, 17))), (5, " ".join(f"w{i}" for i in range(11)))], "d long, text string")
    got = {tuple(r) for r in leakage.prompt_hits(docs, prompts, "d", "p").collect()}
    assert got == {(2, "exact", 1), (3, "span", 2), (4, "span", 3)}
    assert leakage.verdict(0, 0.1, 60) == "PASS" and leakage.verdict(1, 0, 60) == leakage.verdict(0, 0, 3) == "FAIL"


def test_conversations(spark):
    make = lambda c, *m: [(c, i, r, t) for i, (r, t) in enumerate(m)]
    rows = make(1, ("system", "s"), ("user", "Hi"), ("assistant", "yo")) + make(2, ("user", "Hi!"), ("assistant", "b")) + make(3, ("user", "x")) + make(4, ("assistant", "x"), ("user", "y")) + make(5, ("user", " "), ("assistant", "b"))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = dict(map(tuple, conversations.gathered(turns).select("conv_id", conversations.problem(F.col("messages"))).collect()))
    assert got == {1: None, 2: None, 3: "incomplete_pair", 4: "roles_out_of_order", 5: "blank_message"}
    edges = conversations.family_edges(turns.filter("conv_id < 4"))
    comps = conversations.components(edges, cutter(spark))
    assert dict(map(tuple, comps.collect())) == {1: 1, 2: 1, 3: 3}
    assert [r[0] for r in conversations.sealed(comps, edges, spark.createDataFrame([("user:hi",)], "key string")).collect()] == [1]
    text_of = conversations.gathered(turns.filter("conv_id = 1")).select(conversations.render(F.col("messages"))).first()[0]
    assert text_of == "<s><user>s\n\nHi<end><assistant>yo<end>"


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, None)], "g int, p int")
    r = metrics.binary(df, F.col("g"), F.col("p")).first()
    assert (r.n, r.invalid, r.accuracy, r.f1, r.mcc) == (4, 1, 0.5, None, None)


def test_packing(spark):
    rnd = random.Random(5)
    docs = [(i, [rnd.randrange(100) for _ in range(rnd.randrange(0, 30))]) for i in range(40)]
    flat = [t for _, d in docs for t in d]
    want = {r: flat[r * 16 : r * 16 + 17] for r in range(len(flat)) if len(flat[r * 16 : r * 16 + 17]) == 17}
    got = dict(map(tuple, packing.pack(spark.createDataFrame(docs, "i long, t array<long>").repartition(3), "i", "t", 16).collect()))
    assert got == want
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5, 9, 3, 10, 1, 2, 20])], "i long, n long")
    rows = sorted(map(tuple, packing.best_fit(sizes, "i", "n", 10, 1, 3).collect()), key=lambda r: (r[1], r[3]))
    assert {r[2] for r in rows} == {0, 1, 2, 3, 4, 5}
    totals = {}
    for _, row, conv, at in rows:
        assert at == totals.get(row, 0)
        totals[row] = at + [5, 9, 3, 10, 1, 2, 20][conv]
    assert max(totals.values()) <= 10


def test_packing_names_conversations_that_fit_no_row(spark, tmp_path):
    sizes = {0: [100, 1900], 1: [2048], 2: [2000, 49], 3: [5000], 4: [3]}
    turns = [(c, i, "user", "word " * n) for c, ns in sizes.items() for i, n in enumerate(ns)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv: r for r in registry.QUERIES["best_fit_rows"](spark, str(tmp_path)).collect()}
    assert set(got) == set(sizes) and all((got[c].row is None) == (sum(n) > 2048) == (got[c].problem is not None) for c, n in sizes.items())
    assert got[2].problem == "exceeds_row_capacity: 2049 > 2048" and (got[2].rank, got[3].rank) == (0, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\n\ntwo\nlines\n \nthree")
    (tmp_path / "a" / ".hidden.txt").write_text("no")
    lines = ['{"text": "ok", "k": 1}', '{"content": "c"}', '"plain"', "broken{", '{"text": "a", "text": "b"}', '{"text": NaN}', ""]
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    assert [r.text for r in readers.text_files(spark, str(tmp_path / "a")).collect()] == ["one\n\ntwo\nlines\n \nthree"]
    assert [r.text for r in readers.blank_line_documents(spark, str(tmp_path / "a" / "x.txt")).orderBy("input_row").collect()] == ["one", "two\nlines", "three"]
    rows = readers.json_lines(spark, str(tmp_path / "b.jsonl")).collect()
    assert [r.text for r in rows] == ["ok", "c", "plain", None, None, None] and rows[0].meta == {"k": "1"} and rows[0].input_file.endswith("b.jsonl")
    assert [bool(r.problem) for r in rows] == [False, False, False, True, True, True]
    assert [r.text for r in readers.json_lines(spark, str(tmp_path / "b.jsonl"), strict=False).collect()][3] == "broken{"
    (tmp_path / "n.tsv").write_text("1\tfirst\n2\tsecond\nbad")
    assert [(r.number, r.text) for r in readers.numbered_sentences(spark, str(tmp_path / "n.tsv")).collect()] == [(1, "first"), (2, "second"), (None, "")]
    (tmp_path / "w.xml").write_text("<m>" + "".join(f"<page><title>T{i}</title><ns>{i}</ns><revision><id>1</id><text xml:space='preserve'>'''B''' {'word ' * 60}</text></revision></page>" for i in (0, 1)) + "</m>")
    assert [r.title for r in readers.wiki_pages(spark, str(tmp_path / "w.xml")).collect()] == ["T0"]
    raw = spark.createDataFrame([(bytearray("прывітанне, як справы".encode("cp1251")),), (bytearray("ok é".encode()),)], "content binary")
    assert [(r.text, r.codec) for r in readers.decoded(raw).collect()] == [("прывітанне, як справы", "cp1251"), ("ok é", "utf-8-sig")]
    nested = spark.createDataFrame([(json.dumps({"id": "x" * 30, "a": ["y" * 25, {"b": "z" * 25}], "c": "y" * 25, "s": "s"}),)], "j string")
    assert readers.flattened(nested, "j").first().text == "y" * 25 + "\n" + "z" * 25
    both = readers.read_sources(spark, [{"source": "s1", "reader": "text", "path": str(tmp_path / "a")}, {"source": "s2", "reader": "jsonl", "path": str(tmp_path / "b.jsonl")}])
    assert {r.source for r in both.collect()} == {"s1", "s2"}
    with pytest.raises(ValueError, match="pinned"):
        readers.read_sources(spark, [{"source": "s", "reader": "text", "path": str(tmp_path / "n.tsv"), "sha256": "0"}])


def test_codec_is_chosen_on_the_whole_text(spark):
    preface, body = "An English preface of this book. " * 800, "Прывітанне, як справы? Добры дзень. " * 400
    assert len(preface) > 20_000
    raw = spark.createDataFrame([(bytearray((preface + body).encode(c, "replace")), c) for c in ("cp1251", "koi8-r")], "content binary, want string")
    got = {r.want: (r.codec, r.text) for r in readers.decoded(raw).collect()}
    assert {c: x[0] for c, x in got.items()} == {c: c for c in got} and got["cp1251"][1] == preface + body and "\ufffd" not in got["koi8-r"][1]


def test_gates(spark):
    df = spark.createDataFrame([("bel", "Cyrl", 0.95, "a\nb", ["bel", "rus"]), ("bel", "Latn", 0.99, "a", ["bel", "bel"]), (None, "Cyrl", float("nan"), "a", ["bel"])], "language string, script string, score double, text string, labels array<string>")
    assert [r.upstream_reject for r in readers.script_gate(df, "bel", "Cyrl").collect()] == [None, "upstream_language_gate", "upstream_language_gate"]
    assert [(r.text, r.upstream_reject) for r in readers.kept_lines(df, "text", "labels", "bel").collect()] == [("a", None), ("a", "label_count_mismatch"), ("a", None)]


def test_publication(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
    name = sinks.publish({"train": df}, root, {"k": 1})
    assert sinks.current(spark, root).endswith(name) and sinks.same_rows(spark.read.parquet(f"{root}/{name}/train"), df)
    with pytest.raises(ValueError, match="empty"):
        sinks.publish({"train": df.limit(0)}, root)
    assert sinks.current(spark, root).endswith(name)
    again = sinks.publish({"train": df.limit(5)}, root)
    assert sinks.current(spark, root).endswith(again)
    sinks.write_shards(df, str(tmp_path / "s"), "h", 20)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "f string, n long"), spark.createDataFrame([("x", 1), ("z", 3)], "f string, n long")
    assert {r.f for r in sinks.differing(a, b, "f", "n").collect()} == {"y", "z"}


def test_stage_over_a_stream(spark, tmp_path):
    rows = [(1, "s", "good words " * 30), (2, "s", "good words " * 30), (3, "s", "short")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    curation.stage1_stream(stream, curation.Gates(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert [r.source for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["s"]


def test_evaluation(spark):
    events = 'data: {"choices": [{"delta": {"content": "he"}}]}\ndata: {"choices": [{"delta": {"content": "llo"}, "finish_reason": "stop"}]}\ndata: [DONE]'
    got = column(spark, [events, events.split("\n")[0], "data: {bad", None], evals.streamed_answer)
    assert [tuple(r) for r in got] == [("hello", None), (None, "incomplete"), (None, "bad_event"), (None, "incomplete")]
    assert column(spark, ["1", " 0 ", "10", "yes", None], evals.strict_answer) == [1, 0, None, None, None]
    assert evals.step_budget(1001, 100) == {"steps": 11, "eval_every": 1}
    with pytest.raises(ValueError, match="positive"):
        evals.step_budget(0, 1)
    df = spark.createDataFrame([("a", "q", 0.0), ("b", " ", 1.0), ("c", "q", 2.0)], "id string, prompt string, weight double")
    assert [r.problem for r in evals.item(df).orderBy("id").collect()] == ["bad_weight", "no_prompt", None]
