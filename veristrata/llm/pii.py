r"""Personal data by proposed spans, checksums and context words, in DataFrame expressions only.

Regular expressions propose spans; validators (address parts, Luhn, digit
counts, mod-97) confirm them; words within ``CONTEXT`` characters adjust the
score.  Base kinds stay whatever their score; kinds that the method adds need
``MIN_SCORE`` and may not overlap a base span.

Offsets are code points, end exclusive.  A pattern's matches and the gaps
between them give the offsets: both come from the same leftmost,
non-overlapping search.  Patterns start at the edge of a run and use
possessive repetition, so each text is scanned in linear time and no match
recurses, however long the run.

Defined results: a null or empty text has no spans; a very long text is searched
whole; a null id is kept; repeated rows are searched separately; of spans that
start together (ties) the longer comes last in a redaction and the kind decides
nothing; an empty table gives an empty result; extra columns are ignored whatever
their names (and kept by ``redact``, which changes ``text`` and ``n_chars`` only).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.session import col, table

CONTEXT = 40
MIN_SCORE = 0.6

_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """``regex`` proposes (if the text contains ``gate``); ``valid`` gives SQL over the match; a score is ``score``, plus ``boost`` near ``context``."""

    name: str
    gate: str
    regex: str
    valid: Callable[[str], str]
    score: float
    context: str
    boost: float
    base: bool = True


def _always(m: str) -> str:
    return "true"


def _address_parts(m: str) -> str:
    return rf"forall(split({m}, '\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 3) AS INT), 999) <= 255)"


def _luhn(m: str) -> str:
    """Every second digit from the right is doubled; a doubled digit of ten or more counts nine less."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    digit = f"substring({d}, -i, 1)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + IF(i % 2 = 1, 1, 2) * CAST({digit} AS INT) - IF(i % 2 = 0 AND {digit} >= '5', 9, 0)) % 10 = 0"


def _phone_digits(m: str) -> str:
    return f"length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 9 AND 15"


def _mod97(m: str) -> str:
    """The first four characters go last, letters count from ten; the number leaves 1 by 97."""
    bare = f"replace({m}, ' ', '')"
    step = "IF(c BETWEEN '0' AND '9', (a * 10 + CAST(c AS INT)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"length({bare}) BETWEEN 15 AND 34 AND aggregate(split(concat(substring({bare}, 5), substring({bare}, 1, 4)), ''), 0, (a, c) -> {step}) = 1"


KINDS = (
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, 0.9, "mail|contact|write", 0.1),
    Kind("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _address_parts, 0.8, "address|host|server|ip", 0.2),
    Kind("card", "", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", _luhn, 0.8, "card|visa|credit|payment", 0.2),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", _phone_digits, 0.8, "tel|phone|call|fax|mobile", 0.2),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", _mod97, 0.8, "iban|bank|account|konto", 0.2, False),
    Kind("ssn", "-", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", _always, 0.4, "ssn|social security|tax id|taxpayer", 0.5, False),
    Kind("localphone", "", r"(?<![0-9+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", _always, 0.3, "tel|phone|call|fax|mobile|whatsapp", 0.4, False),
)


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _found(k: Kind, text: str) -> str:
    """SQL for the confirmed spans of one kind, folded over the gaps ``x.g`` before and the matches ``x.m``."""
    matches = f"regexp_extract_all({text}, {_quoted(k.regex)}, 0)"
    gaps = f"slice(split({text}, {_quoted(k.regex)}, -1), 1, size({matches}))"
    pairs = f"zip_with({gaps}, {matches}, (g, m) -> named_struct('g', g, 'm', m))"
    start, end = "acc.at + length(x.g)", "acc.at + length(x.g) + length(x.m)"
    near = f"lower(concat(substring({text}, greatest(1, {start} - {CONTEXT} + 1), least({start}, {CONTEXT})), ' ', substring({text}, {end} + 1, {CONTEXT})))"
    span = f"named_struct('kind', '{k.name}', 'start', {start}, 'end', {end}, 'score', round({k.score}D + IF({near} rlike '{k.context}', {k.boost}D, 0D), 2))"
    empty = "CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT, score: DOUBLE>>)"
    step = f"named_struct('at', {end}, 'out', IF({k.valid('x.m')}, array_append(acc.out, {span}), acc.out))"
    fold = f"aggregate({pairs}, named_struct('at', 0, 'out', {empty}), (acc, x) -> {step}, acc -> acc.out)"
    gate = f"contains({text}, '{k.gate}') AND " if k.gate else ""
    return f"IF({gate}{text} rlike {_quoted(k.regex)}, {fold}, {empty})"


def with_spans(docs: DataFrame, text: str = "text", kinds=KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``_doc`` (a struct of all columns of ``docs``), its text ``_t``, an array of spans by each kind, ``_base`` and ``_spans``: by kind as listed, then start."""
    t = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    for k in kinds:
        t = t.withColumn(f"_{k.name}", F.expr(_found(k, "_t")))
    t = t.withColumn("_base", F.concat(*[F.col(f"_{k.name}") for k in kinds if k.base]))
    added = F.concat(*[F.col(f"_{k.name}") for k in kinds if not k.base]) if any(not k.base for k in kinds) else F.slice("_base", 1, 0)
    t = t.withColumn("_spans", F.concat(F.col("_base"), F.filter(added, lambda a: (a["score"] >= min_score) & ~F.exists("_base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))))
    return t


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, counts of base kinds, the digest of base spans, all spans and their scores."""
    t = with_spans(docs.select(key, "text"))
    counts = [F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    scores = F.array_join(F.transform("_spans", lambda s: s["score"].cast("string")), ",")
    return t.select(F.col("_doc")[key].alias(key), *counts, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; texts without spans are untouched, ``n_chars`` follows."""
    t = with_spans(docs).withColumn("_cut", F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        free = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.col("_t").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.when(free, piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("_cut", start, step, lambda acc: F.concat(acc["out"], F.col("_t").substr(acc["at"] + 1, F.length("_t"))))
    of = lambda c: F.col("_doc")[c]
    changed = {c: of(c) for c in docs.columns} | {"text": F.when(F.size("_cut") > 0, clean).otherwise(of("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_cut") > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(of("n_chars"))
    return t.select(*[v.alias(c) for c, v in changed.items()])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
