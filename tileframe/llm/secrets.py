"""Secret scans through a trigram index (DataFrame code only).

Each rule is a regular expression without look-around. ``trigram_query`` derives
from it the Boolean query of trigrams (lower case) that every match contains.
The inverted index holds, for the trigrams that some rule asks for, the ids of the
documents that contain them; ``candidates`` intersects the postings by document.
Only candidates of a rule run its expression; a rule without mandatory trigrams
(a long hexadecimal run) scans every text.

Matches are leftmost and do not overlap within a rule; offsets are code points, the
end is exclusive. The text is split at a rule's matches, and the lengths of the parts
between and of the matches add up to the places. Running sums and maxima double their
reach step by step (``_running``), so the work for a text grows with n log n of its n
matches; masked texts are put together from slices of their fixed-width form.

The candidates are broadcast up to ``BROADCAST_IDS`` of them; with more, documents are
joined to them by shuffle.

Defined cases: a null text counts as empty; a very long text, or one with very many
matches, is scanned whole; repeated and null ids share their postings and are verified
row by row; a document without spans has an empty span list; an empty table gives an
empty result; other columns, whatever their names, are passed through or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as regex_syntax

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MASK = "[SECRET]"
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``value`` and ``least``: matches whose group ``value`` has fewer than ``least``
    characters are dropped after matching."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


#: All from the header to the END line; where another header or no END line follows, the
#: header's fields and the run of base64 lines (also of written-out line ends). Possessive,
#: so that long keys need no stack.
_GAP = r"(?:\s|\\[nr])"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-[^-]++){0,8}+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):\x20?[A-Za-z0-9,-]++)*+"
    rf"(?:(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:(?:[\r\n]|\\[nr])++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+)?)?)"
)
#: Base rules in their fixed order, then those that this scan adds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("git_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("pay_key", r"[rs]k_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A run of literals is followed through classes and options to so many strings.
MAX_STRINGS = 32


def trigram_query(pattern: str):
    """The trigrams that a match must contain: a string is a trigram, ("and", ...) and
    ("or", ...) combine queries, None asks for nothing."""
    strings, query = _sequence(regex_syntax.parse(pattern))
    return _both(query, _of_strings(strings))


def _of_strings(strings):
    if not strings:
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    weakest = sorted(sorted(a) for a in sets if not any(b < a for b in sets))
    parts = [("and", *trigrams) for trigrams in weakest]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _both(a, b):
    return a if b is None or a == b else b if a is None else ("and", a, b)


def _sequence(items):
    """(strings, query): the strings that the end of the sequence can be, from its last
    break on, and the query of what stands before."""
    strings, query = {""}, None
    for item in items:
        own, inner = _item(*item)
        query = _both(query, inner)
        joined = {a + b for a in strings for b in own} if own is not None else set()
        if own is None or len(joined) > MAX_STRINGS:
            query = _both(query, _of_strings(strings))
            strings = {""} if own is None else own
        else:
            strings = joined
    return strings, query


def _item(op, value):
    """(strings, query) of one element; strings is None where they are too many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, None
    if name == "IN":
        chars: set[str] = set()
        for kind, what in value:
            if str(kind) == "LITERAL":
                chars.add(chr(what).lower())
            elif str(kind) == "RANGE" and what[1] - what[0] < MAX_STRINGS:
                chars |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if name == "SUBPATTERN":
        return _whole(value[-1])
    if name == "BRANCH":
        parts = [_whole(branch) for branch in value[1]]
        if all(own is not None and query is None for own, query in parts):
            union = set().union(*[own for own, _ in parts])
            if len(union) <= MAX_STRINGS:
                return union, None
        queries = [_both(query, _of_strings(own) if own is not None else None) for own, query in parts]
        return None, None if None in queries else ("or", *queries)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        own, query = _whole(inner)
        if own is not None and query is None and (least, most) in ((0, 1), (1, 1)):
            return own | ({""} if least == 0 else set()), None
        return None, None if least == 0 else _both(query, _of_strings(own) if own is not None else None)
    return None, None


def _whole(items):
    strings, query = _sequence(items)
    broken = query is not None or any(_item(*item)[0] is None for item in items)
    return (None, _both(query, _of_strings(strings))) if broken else (strings, None)


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams_of(q) for q in query[1:]])


def _holds(query, has) -> Column:
    if isinstance(query, str):
        return has(query)
    parts = [_holds(q, has) for q in query[1:]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def indexed(rules=RULES) -> dict:
    """Rules with a query, and their queries."""
    return {rule.kind: query for rule in rules if (query := trigram_query(rule.pattern)) is not None}


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: trigram, doc_id for every trigram that a rule asks for."""
    asked = sorted(set().union(*[trigrams_of(q) for q in indexed(rules).values()]))
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in asked]))
    return low.select(F.explode(found).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and a Boolean ``may_<kind>`` for each indexed rule; documents that may
    match none are left out."""
    queries = indexed(rules)
    asked = sorted(set().union(*[trigrams_of(q) for q in queries.values()]))
    has = {t: f"has_{k}" for k, t in enumerate(asked)}
    met = index.groupBy("doc_id").agg(*[F.bool_or(F.col("trigram") == t).alias(name) for t, name in has.items()])
    may = met.select("doc_id", *[_holds(query, lambda t: F.col(has[t])).alias(f"may_{kind}") for kind, query in queries.items()])
    return may.filter(reduce(lambda a, b: a | b, [F.col(f"may_{kind}") for kind in queries]))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, op) -> Column:
    """Array of what ``op`` makes of all values up to each one. Step k reaches 2 ** k
    values back, so there are log2(n) steps over the array."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def back(k: Column) -> Column:
        return F.pow(F.lit(2), k).cast("int")

    def double(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, at: F.when(at >= back(k), op(x, F.get(acc, at - back(k)))).otherwise(x))

    return F.aggregate(steps, values, double)


SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def _matches(rule: Rule, order: int, guard: Column | None) -> Column:
    """Array of (start, order, kind, end) of one rule in ``_text``."""
    text, pattern = F.col("_text"), F.lit(rule.pattern)

    def named(found: Column, ends: Column) -> Column:
        value = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.least else found
        parts = F.arrays_zip(found.alias("whole"), value.alias("value"), ends.alias("end"))
        kept = F.filter(parts, lambda m: F.length(m["value"]) >= rule.least) if rule.least else parts
        return F.transform(kept, lambda m: F.struct((m["end"] - F.length(m["whole"])).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")))

    def spans(found: Column) -> Column:
        # Part k between matches is followed by match k: their lengths add up to its end.
        lengths = lambda parts: F.transform(found, lambda m, k: F.length(F.get(parts, k)) + F.length(m))
        ends = _let(_let(F.split(text, rule.pattern), lengths), lambda n: _running(n, lambda a, b: a + b))
        return F.when(F.size(found) > 0, named(found, ends)).otherwise(F.array().cast(SPANS))

    found = _let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)
    return found if guard is None else F.when(F.coalesce(guard, F.lit(False)), found).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``spans``, array of (start, order, kind, end) by start, then rule, to doc_id,
    text and columns whose names cannot clash (see ``common.set_aside``)."""
    may = common.materialize(candidates(postings(docs, rules), rules), "secret-candidates").withColumnRenamed("doc_id", "_id")
    may = F.broadcast(may) if may.count() <= BROADCAST_IDS else may.hint("shuffle_hash")
    checked = docs.join(may, docs["doc_id"].eqNullSafe(may["_id"]), "left").withColumn("_text", F.coalesce("text", F.lit("")))
    guards = {kind: F.col(f"may_{kind}") for kind in indexed(rules)}
    found = checked.withColumns({f"_{rule.kind}": _matches(rule, k, guards.get(rule.kind)) for k, rule in enumerate(rules)})
    spans = F.array_sort(F.concat(*[F.col(f"_{rule.kind}") for rule in rules]))
    return found.withColumn("spans", spans).select(*[docs[c] for c in docs.columns], "spans")


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with MASK for each span; spans that meet earlier ones prolong their mask."""
    # Four bytes a code point, so that a slice costs its own length; a space before each
    # slice is no byte order mark.
    wide = F.encode(text, "UTF-32")
    blank = F.encode(F.lit(" "), "UTF-32")

    def put_together(reach: Column) -> Column:
        def cut(data: Column) -> Column:
            part = lambda start, n: F.substring(F.decode(F.concat(blank, F.substring(data, 4 * start + 1, 4 * n)), "UTF-32"), 2, n)
            before = F.transform(spans, lambda s, k: F.struct(F.when(k == 0, 0).otherwise(F.get(reach, k - 1)).alias("from"), s["start"].alias("to")))
            gaps = F.filter(before, lambda g: g["to"] >= g["from"])
            parts = F.transform(gaps, lambda g: part(g["from"], g["to"] - g["from"]))
            end = F.element_at(reach, -1)
            return F.array_join(F.concat(parts, F.array(part(end, F.length(text) - end))), MASK)

        return _let(wide, cut)

    return _let(_running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), put_together)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by a mask, n_chars to match."""
    inner, names = common.set_aside(docs, "doc_id", "text", "n_chars")
    found = F.size("spans") > 0
    scanned = scan(inner).withColumn("text", F.when(found, _masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        scanned = scanned.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return scanned.select(*names)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.bare(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *[count(rule.kind) for rule in BASE_RULES], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
