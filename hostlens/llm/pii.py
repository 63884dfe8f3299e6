"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Each kind has a pattern, a check and a base score. Context words within `WINDOW` characters before or after a span,
other matches included, raise the score; words that name something else lower it. Spans that reach `THRESHOLD` are reported.
Email, ip, card and phone spans that pass their check always reach it; iban (mod-97) does on its checksum, and national
ids and bank account numbers, which have no checksum, only with a context word.

Positions come from splitting the text at the matches: with the gaps and the matches as two arrays, a match starts
where the lengths so far add up to. Patterns start only where the run they look for starts, so that long runs are read
once. All of it is DataFrame functions; documents are never shuffled.

Defined results: a null text counts as empty, with no spans; a document of any length is one row; repeated rows are
judged alike; an empty table gives an empty result.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

WINDOW = 40
THRESHOLD = 0.5

# The patterns of the four base kinds. \G lets a match start right where the one before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Countries by the length of their IBANs, so that a match takes in nothing that follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    def rest(n: int) -> str:
        return rf"(?:[\x20]?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"[\x20]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    each = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}{rest(n)}" for n, c in IBAN_LENGTHS.items()]
    # Countries that are not listed: any length, as the checksum decides.
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]{{4}}){{2,7}}(?:[\x20]?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(each)}|{other})(?![A-Za-z0-9])"


IBAN = _iban()
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![0-9])[0-9]{8,11}(?![0-9])"
#: Key ids of a fixed form, and values of ten or more characters with a digit that are assigned to a word for a secret.
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
CREDENTIAL = r"""(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?["']?(?=[a-z_+/-]*[0-9])[a-z0-9_+/-]{10,}+={0,2}"""


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = F.reverse(digits(m))
    n = F.length(d)

    def value(k: Column) -> Column:
        x = F.substring(d, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, k: a + value(k)) % 10 == 0)


def mod97(m: Column) -> Column:
    """Whether m, an IBAN with or without spaces, leaves 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(a: Column, k: Column) -> Column:
        c = F.ascii(F.substring(s, k, F.lit(1)))
        return F.when(c >= 65, (a * 100 + (c - 55)) % 97).otherwise((a * 10 + (c - 48)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; `needs` is a text that every match contains, asked for before the pattern is tried."""

    name: str
    pattern: str
    score: float
    raised_by: str = ""
    lowered_by: str = ""
    needs: str = ""

    def confirmed(self, m: Column) -> Column:
        n = F.length(digits(m))
        return {
            "ip": m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
            "card": n.between(12, 19) & luhn(m),
            "phone": n.between(9, 15),
            "iban": F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m),
        }.get(self.name, F.lit(True))


BASE = (
    Kind("email", EMAIL, 0.8, r"mail|contact|write", needs="@"),
    Kind("ip", IP, 0.6, r"\bip\b|address|server|host", r"version|release"),
    Kind("card", CARD, 0.7, r"card|visa|credit|payment", r"order|serial|isbn"),
    Kind("phone", PHONE, 0.7, r"phone|tel|call|mobile|fax", needs="+"),
)
KINDS = (
    *BASE,
    Kind("iban", IBAN, 0.7, r"iban|bank|account"),
    Kind("national_id", NATIONAL, 0.2, r"ssn|social security|national id", needs="-"),
    Kind("account", ACCOUNT, 0.1, r"account (?:no|number)|konto|cuenta|compte"),
    Kind("access_key", ACCESS_KEY, 0.7, r"key|access|aws", needs="AKIA"),
    Kind("credential", CREDENTIAL, 0.6, r"login|user|config|env", r"example|dummy|placeholder"),
)
RAISE, LOWER = 0.4, 0.15


def worth(text: Column, kind: Kind) -> Column:
    """A cheap test that every text with a match passes."""
    return F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike(QUICK[kind.name])


BLOCK = 256


def pairs(text: Column, hits: Column, kind: Kind) -> Column:
    """array<struct<gap, tail, head, m, at>>: the length before each match, the last and first of what is there in lower
    case, the match and its index; a last one without a match."""

    def one(g: Column, m: Column) -> Column:
        tail, head = F.lower(F.substring(g, -WINDOW, WINDOW)), F.lower(F.substring(g, 1, WINDOW))
        return F.struct(F.length(g).alias("gap"), tail.alias("tail"), head.alias("head"), m.alias("m"))

    found = F.transform(F.zip_with(F.split(text, kind.pattern, -1), hits, one), lambda p, k: F.struct(p["gap"], p["tail"], p["head"], p["m"], k.alias("at")))
    return F.when(F.size(hits) > 0, found)


#: A match has two characters at least and one between it and the next, or three: so many of them fill the window.
AROUND = 20


def context(found: Column, p: Column) -> Column:
    """The WINDOW characters before and after p, one of the pairs in found, in lower case."""
    low = F.greatest(p["at"] - AROUND, F.lit(0))
    match = lambda q, start: F.lower(F.coalesce(F.substring(q["m"], start, WINDOW), F.lit("")))
    before = F.transform(F.slice(found, low + 1, p["at"] - low), lambda q: F.concat(q["tail"], match(q, -WINDOW)))
    after = F.transform(F.slice(found, p["at"] + 2, F.lit(AROUND)), lambda q: F.concat(q["head"], match(q, 1)))
    before, after = F.concat(F.array_join(before, ""), p["tail"]), F.array_join(after, "")
    return F.concat(F.substring(before, -WINDOW, WINDOW), F.lit("\n"), F.substring(after, 1, WINDOW))


def placed(found: Column, kind: Kind) -> Column:
    """array<struct<start, end, near>> of the matches that pass the check; start and end are zero-based code points.

    found is a column of pairs. Running lengths give the positions. An array that grows by one element is copied each
    time, so they are added up in blocks: first over the blocks, then inside each.
    """
    none = F.expr("array()").cast("array<struct<start:int,end:int,near:string>>")

    def block(b: Column) -> Column:
        return F.slice(found, b * BLOCK + 1, F.lit(BLOCK))

    def width(p: Column) -> Column:
        return p["gap"] + F.coalesce(F.length(p["m"]), F.lit(0))

    def step(a: Column, p: Column) -> Column:
        s, e = a["at"] + p["gap"], a["at"] + width(p)
        span = F.struct(s.alias("start"), e.alias("end"), context(found, p).alias("near"))
        good = p["m"].isNotNull() & kind.confirmed(p["m"])
        return F.struct(e.alias("at"), F.when(good, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    widths = F.transform(numbers, lambda b: F.aggregate(block(b), F.lit(0), lambda a, p: a + width(p)))
    first = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<int>").alias("starts"))
    starts = F.aggregate(widths, first, lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    each = F.zip_with(numbers, starts, lambda b, s: F.aggregate(block(b), F.struct(s.alias("at"), none.alias("spans")), step, lambda a: a["spans"]))
    return F.when(F.size(found) > 0, F.flatten(each))


def scored(spans: Column, kind: Kind, threshold: float) -> Column:
    """SPANS of one kind with their scores; null where there are none. Base kinds do not need the threshold."""
    rank, base = [k.name for k in KINDS].index(kind.name), kind in BASE

    def one(s: Column) -> Column:
        near = s["near"]
        up = F.when(near.rlike(kind.raised_by), RAISE).otherwise(0.0) if kind.raised_by else F.lit(0.0)
        down = F.when(near.rlike(kind.lowered_by), LOWER).otherwise(0.0) if kind.lowered_by else F.lit(0.0)
        score = F.least(F.lit(1.0), F.lit(kind.score) + up - down)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), F.lit(base).alias("base"), F.round(score, 3).alias("score")
        )

    out = F.transform(spans, one)
    return F.when(F.size(spans) > 0, out if base else F.filter(out, lambda s: s["score"] >= threshold))


SPANS = "array<struct<start:int,end:int,rank:int,kind:string,base:boolean,score:double>>"
#: Cheap tests that every text with a match passes, for kinds without a fixed character.
QUICK = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "iban": r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]{4}",
    "account": r"[0-9]{8}",
    "credential": r"(?i)(?:pass|pwd|secret|token|key)[a-z]*[\x20]?[=:]",
}


def personal_data(docs: DataFrame, column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with pii, the spans that reach the threshold, by start and then kind as listed; pii_ if docs have a pii."""
    pii_name = free_name(docs, "pii")
    names = docs.columns
    text, hits, gaps, spans, every = (free_name(docs, f"pii_{x}") for x in ("text", "hits", "gaps", "spans", "every"))
    # Each step is a projection of its own, as its columns are used more than once by the next.
    out = docs.withColumn(text, F.coalesce(F.col(column), F.lit("")))
    out = out.withColumns({f"{hits}_{k.name}": F.when(worth(F.col(text), k), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))) for k in KINDS})
    out = out.withColumns({f"{gaps}_{k.name}": pairs(F.col(text), F.col(f"{hits}_{k.name}"), k) for k in KINDS})
    out = out.withColumns({f"{spans}_{k.name}": placed(F.col(f"{gaps}_{k.name}"), k) for k in KINDS})
    none = F.expr("array()").cast(SPANS)
    found = F.concat(*[F.coalesce(scored(F.col(f"{spans}_{k.name}"), k, threshold), none) for k in KINDS])
    out = out.withColumn(every, found)
    order = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))

    def on_base(s: Column) -> Column:
        return F.exists(every, lambda b: b["base"] & (b["start"] <= s["start"]) & (s["end"] <= b["end"]))

    # A base span stays; another kind's span that lies inside one says nothing new, one that reaches outside does.
    pii = F.when(F.size(every) > 1, F.filter(order, lambda s: s["base"] | ~on_base(s))).otherwise(F.col(every))
    return out.select(*[f"`{c}`" for c in names], pii.alias(pii_name))


def redacted(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with pii and redacted, the text with each span replaced by its kind in angle brackets."""
    out, pii = personal_data(docs, column), free_name(docs, "pii")
    text = F.coalesce(F.col(column), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        mark = F.concat(F.lit("<"), s["kind"], F.lit(">"))
        inside = s["start"] < a["at"]  # overlaps the span before it
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["text"]).otherwise(F.concat(a["text"], between, mark)).alias("text"))

    end = F.aggregate(pii, start, step, lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))))
    return out.withColumn(free_name(docs, "redacted"), end)


def with_scores(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["score"].cast("string"))), ",")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = personal_data(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")

    return out.select("doc_id", *[count(k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(joined(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), with_scores(F.col("pii")).alias("scores"))
