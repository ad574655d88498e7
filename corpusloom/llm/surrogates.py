"""PII: entities are found and replaced by keyed surrogates of the same type, gender, script and format.

A surrogate is drawn from an HMAC of the key, the kind and the entity's canonical form, so one entity has one surrogate in all
documents (coreference) and nobody without the key can invert it. Names are replaced by part, so that a surname alone and
a full name stay consistent. A corpus-wide check keeps distinct entities distinct: of entities that draw the same surrogate, and of those that draw
an entity of the corpus, all but one draw again, until none is left; only those second draws travel back to the documents. Names and mail
addresses get longer with the attempts; private IP addresses move to 10.x; what still collides in a space of fixed size gets a free place of it.

Names are found after a title, and then, without one, wherever else their document has them. Feminine and masculine forms of a Cyrillic surname are
one entity, and each form gets the surrogate in that form.

Null stays null, empty stays empty; repeated rows get the same replacements, and so do rows of one id; where two kinds could begin at one place, the
earlier of KINDS wins; an empty table gives no rows; columns other than id and text are kept by replace_private().
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import Scratch, batches_of, col, id_text, rows_of, small, small_batches, unused

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "given", "surname")
EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,5}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")
TITLES = {
    "mr": "m", "mrs": "f", "ms": "f", "miss": "f", "dr": "n", "prof": "n", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "señor": "m", "señora": "f", "sr": "m", "sra": "f",
    "господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f", "κύριος": "m", "κυρία": "f", "السيد": "m", "السيدة": "f", "גברת": "f",
}
#: Titles that are words or names of their own when they don't begin with a capital.
_CAPITAL = ("sr", "mr", "ms", "dr", "prof")
PERSON = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})(\.? )([^\W\d_]+(?:-[^\W\d_]+)?)(?:( )([^\W\d_]+(?:-[^\W\d_]+)?))?", re.I)
_NAME = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Given names by gender (n: not told by the title) and script; other scripts take made ones.
GIVEN = {
    ("m", "latin"): "Adam Albert Anton Arthur Bruno Carl Daniel David Edgar Emil Felix Frank George Henry Hugo Jacob James Jonas Julian Leo Louis Lucas Martin Max Oscar Paul Peter Robert Samuel Simon Theo Thomas Victor Walter".split(),
    ("f", "latin"): "Ada Alice Amelia Anna Beatrice Clara Diana Edith Elena Ella Emma Eva Flora Grace Hanna Helen Ida Irene Iris Julia Laura Lea Lena Lucia Maria Martha Mia Nora Olivia Paula Rosa Sara Sofia Vera".split(),
    ("n", "latin"): "Alex Casey Charlie Jamie Jordan Kim Morgan Noa Quinn Riley Robin Sasha Taylor Toni".split(),
    ("m", "cyrillic"): "Адам Алексей Андрей Антон Борис Виктор Глеб Денис Иван Игорь Кирилл Лев Максим Михаил Олег Павел Пётр Роман Сергей Степан".split(),
    ("f", "cyrillic"): "Алина Алла Анна Вера Галина Дарья Елена Ирина Лидия Любовь Мария Надежда Нина Ольга Полина Раиса Светлана София Тамара Юлия".split(),
    ("n", "cyrillic"): "Валя Женя Саша Слава Шура".split(),
}
#: Syllables and endings of made names, by script.
PARTS = {
    "latin": ("ba be bo da de do fa fe ga ge ha he ka ke la le lo ma me mo na ne no ra re ro sa se ta te va ve".split(), "n r s t l m".split()),
    "cyrillic": ("ба бе бо ва ве да де за ка ко ла ле ло ма ме на но па ра ре ро са се та те".split(), "н р с т л м".split()),
    "greek": ("βα βε γα δα δι κα κο λα λε λι μα με νι νο πα πε ρα ρο σα σι τα τε".split(), "κης δης λος νας".split()),
    "hebrew": ("בא גו דל הד זי טו כר לב מי נו סל עו פר צו קל רו שי תל".split(), "ן ם ר ל".split()),
    "arabic": ("با تا جا حا دا را زا سا شا طا عا فا قا كا لا ما نا".split(), "د ر م ن ي".split()),
    "armenian": ("բա գա դա կա լա մա նա պա սա տա վա".split(), ["յան"]),
    "georgian": ("ბა გა და ვა კა ლა მა ნა რა სა ტა ქა".split(), "ძე შვილი".split()),
    "devanagari": ("का गा चा जा ता दा ना पा बा मा रा ला सा".split(), "न र ल व".split()),
    "cjk": ("安 白 常 丁 方 高 何 江 林 罗 孟 宁 潘 秦 任 沈 唐 魏 徐 叶".split(), "明 华 平 文 宇 春 秋 雨".split()),
    "hangul": ("가 나 다 라 마 바 사 아 자 하 민 서 지 현 우".split(), "준 호 영 수 진".split()),
    "hiragana": ("あ か さ た な は ま や ら わ き し".split(), "え こ み と".split()),
    "katakana": ("ア カ サ タ ナ ハ マ ヤ ラ ワ キ シ".split(), "エ コ ミ ト".split()),
}
#: Cyrillic surnames by the endings of their masculine and feminine forms; others don't tell the gender.
ENDINGS = (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"))


def script_of(word: str) -> str:
    """The script of the first letter, as in its Unicode name; latin where no surrogates are made in it."""
    name = next((unicodedata.name(c, "").split(" ")[0].lower() for c in word if c.isalpha()), "latin")
    return name if name in PARTS else "latin"


def base_form(surname: str) -> str:
    """The lower-case surname; a feminine Cyrillic one in its masculine form, so that both are one entity."""
    low = surname.lower()
    return next((low[: -len(f)] + m for m, f in ENDINGS if low.endswith(f) and len(low) > len(f) + 1), low)


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) in order, without overlaps; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []  # by start

    def add(a: int, b: int, kind: str, canonical: str) -> None:
        i = bisect.bisect_left(found, (a,))
        if (not i or found[i - 1][1] <= a) and (i == len(found) or found[i][0] >= b):
            found.insert(i, (a, b, kind, canonical))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email", m[0].lower())
    if re.search(r"\d[\d .()-]{5}|\d\.\d", text):
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and _iban_number(plain) % 97 == 1:
                add(*m.span(), "iban", plain)
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 13 <= len(digits) <= 19:
                add(*m.span(), "card", digits)
        for m in SSN.finditer(text):
            add(*m.span(), "ssn", re.sub(r"\D", "", m[0]))
        for m in IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                add(*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15:
                add(*m.span(), "phone", digits)
    parts: dict[str, tuple[str, str]] = {}  # of the names found
    low = text.lower()
    for m in PERSON.finditer(text) if any(t in low for t in _MAYBE) else ():
        first, second = m[3], m[5]
        if first[0].islower() or m[1].lower() in _CAPITAL and not m[1][0].isupper():
            continue
        gender = TITLES[m[1].lower()]
        full = second and not second[0].islower() and second[0].isupper() == first[0].isupper()
        if full:
            given = "given", f"{gender}:{script_of(first)}:{first.lower()}"
            add(*m.span(3), *given)
            parts.setdefault(first.lower(), given)
        last, span = (second, m.span(5)) if full else (first, m.span(3))
        surname = "surname", f"{script_of(last)}:{base_form(last)}"
        add(*span, *surname)
        parts[base_form(last)] = surname
    for m in _NAME.finditer(text) if parts else ():  # the same names without a title
        own = parts.get(m[0].lower()) or parts.get(base_form(m[0]))
        if own and not m[0][0].islower():
            add(*m.span(), *own)
    return found


#: What a text with a title holds, in lower case; searched first, as that is many times faster than the pattern.
_MAYBE = [t + end for t in TITLES for end in (" ", ". ")]


class _Draw:
    """Numbers from an HMAC."""

    def __init__(self, key: bytes, *what: str):
        self.seed, self.n, self.left = hmac.new(key, "\0".join(what).encode(), hashlib.sha256).digest(), 0, 0
        self.left = int.from_bytes(self.seed, "big")

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.n += 1
            self.left = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
        self.left, out = divmod(self.left, n)
        return out

    def word(self, script: str, parts: int, end: str | None = None) -> str:
        syllables, ends = PARTS[script]
        return "".join(syllables[self.below(len(syllables))] for _ in range(parts)) + (end or ends[self.below(len(ends))])


#: From this attempt on, addresses of a small private range are drawn from 10.x.
WIDER = 8
#: attempt - PLACE is a place in the entity's space (space_of), from 0.
PLACE = 1_000
_HOSTS = [x for x in range(11, 224) if x not in (127, 172, 192)]


def _fixed_octets(canonical: str) -> int:
    o = canonical.split(".")
    return 1 if o[0] in ("10", "127") else 2 if o[:2] == ["192", "168"] or o[0] == "172" and 16 <= int(o[1]) < 32 else 0


def space_of(kind: str, canonical: str) -> tuple[str, int] | None:
    """Name and size of the entity's space of surrogates if that is fixed and small enough to fill up."""
    if kind == "ssn":
        return "", 100 * 99 * 9999
    if kind == "ip" and _fixed_octets(canonical):
        return ("127", 1 << 24) if canonical.startswith("127.") else ("private", (1 << 24) + (1 << 20) + (1 << 16))
    if kind == "phone" and len(canonical) <= 10:
        return str(len(canonical)), 8 * 10 ** (len(canonical) - 1)
    if kind == "phone":
        return canonical[: len(canonical) - 10] + "+", 8 * 10**9
    return None


def place(kind: str, space: str, i: int) -> str:
    """The i-th surrogate of a space."""
    if kind == "ssn":
        return f"9{i // (99 * 9999):02d}{1 + i // 9999 % 99:02d}{1 + i % 9999:04d}"
    if kind == "phone":
        keep, n = (space[:-1], 10) if space.endswith("+") else ("", int(space))
        return f"{keep}{i + 2 * 10 ** (n - 1):0{n}d}"
    if space == "127":
        i += 127 << 24
    else:
        i += 10 << 24 if i < 1 << 24 else (172 << 24) + (16 << 16) - (1 << 24) if i < (1 << 24) + (1 << 20) else (192 << 24) + (168 << 16) - (1 << 24) - (1 << 20)
    return ".".join(str(i >> b & 255) for b in (24, 16, 8, 0))


def draw(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the surrogate."""
    if attempt >= PLACE:
        return place(kind, space_of(kind, canonical)[0], attempt - PLACE)
    d = _Draw(key, kind, canonical, str(attempt))
    if kind == "email":
        domain = canonical.split("@")[1]
        end = domain.rsplit(".", 1)[1]
        own = _Draw(key, "domain", domain)  # one domain stays one domain
        return f"{d.word('latin', 3)}.{d.below(100_000 * 10 ** (attempt // 3))}@{own.word('latin', 3)}{own.below(1000)}.example.{end}"
    if kind == "iban":
        body = "".join(str(d.below(10)) if c.isdigit() else chr(65 + d.below(26)) for c in canonical[4:])
        return canonical[:2] + f"{98 - _iban_number(canonical[:2] + '00' + body) % 97:02d}" + body
    if kind == "card":
        body = canonical[0] + "".join(str(d.below(10)) for _ in canonical[2:])
        valid = next(c for c in "0123456789" if luhn(body + c))
        return body + (valid if luhn(canonical) else str((int(valid) + 1 + d.below(9)) % 10))
    if kind == "ssn":
        return f"9{d.below(100):02d}{1 + d.below(99):02d}{1 + d.below(9999):04d}"
    if kind == "ip":
        fixed = _fixed_octets(canonical)
        first = ["10"] if fixed == 2 and attempt >= WIDER else canonical.split(".")[:fixed] or [str(_HOSTS[d.below(210)])]
        return ".".join(first + [str(d.below(256)) for _ in range(4 - len(first))])
    if kind == "phone":
        keep = max(0, len(canonical) - 10)  # the country's code
        body = [str(2 + d.below(8)) if i == 0 else str(d.below(10)) for i in range(len(canonical) - keep)]
        return canonical[:keep] + "".join(body)
    if kind == "given":
        gender, script, _ = canonical.split(":")
        names = GIVEN.get((gender, script))
        if names is None:
            return f"{gender}:{script}:{d.word(script, 1 + attempt // 2)}"
        name = names[d.below(len(names))]
        if attempt < 2:
            return f"{gender}:{script}:{name.lower()}"
        # the first part has the gender; the second grows without bound
        return f"{gender}:{script}:{name.lower()}-{names[d.below(len(names))].lower() if attempt < 4 else d.word(script, attempt // 2)}"
    script, name = canonical.split(":")
    end = next((m for m, _ in ENDINGS if name.endswith(m)), "ко") if script == "cyrillic" else None
    made = d.word(script, 2 + d.below(2) + attempt // 3, end)
    return f"{script}:{made if not end or end[0] not in 'оеёиы' else made[: -len(end) - 1] + end}"  # one vowel where two meet


def shaped(original: str, kind: str, surrogate: str) -> str:
    """The surrogate's canonical form in the format of the original: separators and letter case."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(surrogate)
        return "".join(next(rest, "") if c.isalnum() else c for c in original)
    if kind in ("email", "ip"):
        return surrogate.upper() if original.isupper() else surrogate
    name = surrogate.rsplit(":", 1)[1]
    if kind == "surname" and base_form(original) != original.lower():  # a feminine form
        name = next((name[: -len(m)] + f for m, f in ENDINGS if name.endswith(m)), name)
    return name.upper() if len(original) > 1 and original.isupper() else "-".join(p.capitalize() for p in name.split("-")) if original[0].isupper() else name


def _units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    kind = df.select(col(id_col)).schema[0].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("kind", pa.string()), ("canonical", pa.string())])

    def run(batches):
        return batches_of(((i, k, c) for i, text in rows_of(batches, "doc_id", "text") for k, c in {(k, c) for _, _, k, c in find(text.decode("utf-8", "replace"))}), schema)

    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {kind.simpleString()}, kind string, canonical string")


def _drawn(units: DataFrame, key: bytes) -> DataFrame:
    @F.pandas_udf("string")
    def surrogate(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([draw(key, k, c, a) for k, c, a in zip(kind, canonical, attempt, strict=True)])

    return units.select("kind", "canonical", "attempt", surrogate("kind", "canonical", "attempt").alias("surrogate"))


def second_draws(units: DataFrame, key: bytes, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(kind, canonical, attempt) of the entities, of units (kind, canonical), whose first surrogate isn't theirs alone."""
    now = scratch.cut(_drawn(units.withColumn("attempt", F.lit(0)), key), "draws")
    for turn in range(rounds):
        # the fewest attempts, then the least hash, keeps a surrogate
        keeper = F.min(F.struct("attempt", F.xxhash64("canonical").alias("h"), "canonical"))["canonical"].alias("keeper")
        shared = now.groupBy("kind", "surrogate").agg(keeper, F.count("*").alias("n")).filter("n > 1").select("kind", "surrogate", "keeper")
        lost = now.join(shared, ["kind", "surrogate"]).filter("canonical <> keeper").select("kind", "canonical")
        real = now.join(units.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "canonical")
        again = scratch.cut(lost.union(real).distinct(), "again")
        if not again.limit(1).count():
            return now.filter("attempt > 0").select("kind", "canonical", "attempt")
        if turn == rounds - 1:
            held = now.join(again, ["kind", "canonical"], "left_anti")
            return held.filter("attempt > 0").select("kind", "canonical", "attempt").unionByName(_placed(units, again, held, key, scratch))
        moved = now.join(again, ["kind", "canonical"], "left_semi").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        before, now = now, scratch.cut(now.join(again, ["kind", "canonical"], "left_anti").unionByName(_drawn(moved, key)), "draws")
        scratch.drop(before, again)
    raise ValueError("rounds must be 1 or more")


def _nth(kind: str, space: str):
    @F.pandas_udf("string")
    def nth(i: pd.Series) -> pd.Series:
        return pd.Series([place(kind, space, x) for x in i])

    return nth


def _placed(units: DataFrame, left: DataFrame, held: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, canonical, attempt): for the entities left, the first free places of their spaces, in an order that only the key gives."""

    @F.pandas_udf("struct<space string, size long, turn string>")
    def named(kind: pd.Series, canonical: pd.Series) -> pd.DataFrame:
        out = [(*(space_of(k, c) or (None, None)), hmac.new(key, f"place\0{k}\0{c}".encode(), hashlib.sha256).hexdigest()) for k, c in zip(kind, canonical, strict=True)]
        return pd.DataFrame({"space": [o[0] for o in out], "size": pd.Series([o[1] for o in out], dtype="Int64"), "turn": [o[2] for o in out]})

    left = scratch.cut(left.withColumn("_s", named("kind", "canonical")).select("kind", "canonical", "_s.*"), "left")
    taken = held.select("kind", "surrogate").unionByName(units.select("kind", F.col("canonical").alias("surrogate")))
    out = None
    for kind, space, size, n in (tuple(r) for r in left.groupBy("kind", "space", "size").count().collect()):
        if space is None:
            raise RuntimeError(f"surrogates of {n} entities of kind {kind} still collide after all rounds")
        used = taken.filter(F.col("kind") == kind).select("surrogate")
        # at most used.count() of the first places are taken
        free = left.sparkSession.range(min(size, n + used.count())).withColumn("surrogate", _nth(kind, space)("id")).join(used, "surrogate", "left_anti").select("id").orderBy("id").limit(n)
        free = scratch.cut(free.withColumn("r", F.row_number().over(W.orderBy("id"))), "free")
        if free.count() < n:
            raise RuntimeError(f"the {size} surrogates of kind {kind} are fewer than the corpus needs besides its own entities")
        mine = left.filter((F.col("kind") == kind) & (F.col("space") == space)).withColumn("r", F.row_number().over(W.orderBy("turn", "canonical")))
        some = scratch.cut(mine.join(free, "r").select("kind", "canonical", (F.col("id") + PLACE).cast("int").alias("attempt")), "placed")
        out = some if out is None else out.unionByName(some)
    return out


def replace_private(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with text_col replaced, and with private_spans: the entities' places in the old text, as kind:start:end by start."""
    scratch = Scratch(df.sparkSession, "surrogates")
    each = scratch.cut(_units(df, id_col, text_col), "units")
    again = scratch.cut(second_draws(each.select("kind", "canonical").distinct(), key, scratch), "second")
    draws, draws_id, new = (unused(n, df) for n in ("_draws", "_draws_id", "_new"))
    per = each.join(small(again), ["kind", "canonical"]).distinct().groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct("kind", "canonical", "attempt"))).alias(draws))
    per = scratch.cut(per.withColumnRenamed("doc_id", draws_id), "draws_of")

    @F.pandas_udf("struct<text string, spans string>")
    def replaced(texts: pd.Series, draws: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for text, more in zip(texts, draws, strict=True):
            if not text:
                out.append((text, ""))
                continue
            attempts = {(x["kind"], x["canonical"]): x["attempt"] for x in json.loads(more)} if more else {}
            parts, spans, at = [], [], 0
            for a, b, kind, canonical in find(text):
                what = kind, canonical, attempts.get((kind, canonical), 0)
                if what not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[what] = draw(key, *what)
                parts += [text[at:a], shaped(text[a:b], kind, known[what])]
                spans.append(f"{kind}:{a}:{b}")
                at = b
            out.append(("".join([*parts, text[at:]]), ",".join(spans)))
        return pd.DataFrame(out, columns=["text", "spans"])

    joined = df.join(small(per), col(id_col).eqNullSafe(F.col(draws_id)), "left")
    joined = joined.withColumn(new, replaced(col(text_col), F.col(draws)))
    return joined.withColumn(text_col, F.col(new)["text"]).withColumn("private_spans", F.col(new)["spans"]).drop(new, draws, draws_id)


def op6_result(df: DataFrame) -> DataFrame:
    counts = (F.regexp_count("private_spans", F.lit(f"(^|,){k}:")).cast("long").alias(f"n_{k}") for k in KINDS)
    return df.select("doc_id", *counts, F.col("private_spans").alias("spans"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
