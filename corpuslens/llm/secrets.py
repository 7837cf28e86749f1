"""Operator 10: secret scanning over a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression is parsed on the driver into a Boolean query
over trigrams that every match must contain.  The inverted index holds, for
each trigram that some rule asks for and each block of ``1 << BLOCK_BITS``
doc_ids, a posting list: the sorted ids whose lower-cased text has it.  A
rule's query is answered block by block, by intersecting and uniting posting
lists, and what is left are its candidates.  Only there its expression runs,
over the whole text.  A rule without mandatory trigrams runs over every text,
and every rule over texts without a doc_id, which no posting can name.

Positions come from the lengths of what lies between and within the matches,
as running sums, so a text with many matches costs no more per match.

Defined results: a null or empty text has no spans (zero counts, the digest of
the empty string); rows that repeat a doc_id, or have a null one, keep a row
each; a very long text is one posting a trigram; an empty table gives no rows.
Masking covers the union of all spans, found on the text as it came; where
spans overlap or touch, they become one mark, of the kind that starts first
(of equals, the one listed first).  Columns of a masked table may have any
names but those that begin with two underscores.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K, _parser as P

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

#: Strings that a part of an expression may expand to before it is cut.
EXPAND = 16
#: Doc_ids of one block of the index: a posting list holds at most 1 << BLOCK_BITS ids.
BLOCK_BITS = 14
#: Code points of a segment of a text that is masked.
SEGMENT = 4096


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    #: The group whose length counts, and its least length.
    group: int = 0
    least: int = 1
    base: bool = False


#: Kinds in the order that breaks ties; the first three are the base rules (fixed values).
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    SecretRule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("hosted_git", r"gh[opsur]_[A-Za-z0-9]{30,}"),
    SecretRule("chat_hook", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

ALL = ("all",)


def _and(parts: list) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    return _or([_and([("has", s[i : i + 3].lower()) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _derive(items) -> tuple[set[str] | None, tuple]:
    """The exact strings that a parsed sequence can match, if few, and the trigrams that each match must have."""
    run, needs, exact = {""}, [], True

    def cut(then: set[str]) -> None:
        nonlocal run, exact
        needs.append(_of_strings(run))
        run, exact = then, False

    for op, arg in items:
        own: set[str] | None = None
        also = ALL
        if op is K.LITERAL:
            own = {chr(arg)}
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 6:
            own = {chr(a) for _, a in arg}
        elif op is K.SUBPATTERN:
            own, also = _derive(arg[3])
        elif op is K.BRANCH:
            parts = [_derive(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                own = set().union(*(s for s, _ in parts))
            also = _or([_of_strings(s) if s is not None else q for s, q in parts])
            if own is not None and len(own) <= EXPAND:
                also = ALL
            else:
                own = None
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, most, inner = arg
            strings, query = _derive(inner)
            if strings is not None and (least, most) == (0, 1):
                own = strings | {""}
            elif least >= 1:
                also = query if strings is None else _of_strings(strings)
        elif op is K.AT:
            continue
        if own is not None and len(run) * len(own) <= EXPAND:
            run = {a + b for a in run for b in own}
        else:
            cut(own if own is not None and len(own) <= EXPAND else {""})
        needs.append(also)
    if exact and _and(needs) == ALL:
        return run, _of_strings(run)
    needs.append(_of_strings(run))
    return None, _and(needs)


def trigram_query(pattern: str) -> tuple:
    """A Boolean query, in lower case: ``("all",)``, ``("has", t)``, ``("and", ...)`` or ``("or", ...)``."""
    return _derive(P.parse(pattern))[1]


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams_of, query[1:])) if query[0] in ("and", "or") else set()


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index ``(block, trigram, postings)`` over lower-cased whole texts; postings ascend."""
    folded = docs.filter("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), t) for t in trigrams)))
    rows = folded.select("doc_id", F.explode(found).alias("trigram"))
    block = F.shiftright(F.col("doc_id"), BLOCK_BITS).alias("block")
    return rows.groupBy(block, "trigram").agg(F.sort_array(F.collect_set("doc_id")).alias("postings"))


def _answer(query: tuple, lists: Column) -> Column:
    """The ids that meet ``query``, from a block's map of trigrams to postings."""
    if query[0] == "has":
        return F.coalesce(lists[query[1]], F.array().cast("array<long>"))
    out = _answer(query[1], lists)
    for q in query[2:]:
        out = (F.array_intersect if query[0] == "and" else F.array_union)(out, _answer(q, lists))
    return out


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, may)``: the rules whose trigram queries a document meets; rules that scan all are left out."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALL}
    asked = sorted(set().union(*map(trigrams_of, queries.values())))
    index = trigram_index(docs.select(F.col("doc_id").cast("long"), "text"), asked)
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    answers = F.array(*(F.struct(F.lit(kind).alias("kind"), _answer(q, F.col("lists")).alias("ids")) for kind, q in queries.items()))
    met = blocks.select(F.explode(answers).alias("a")).select("a.kind", F.explode("a.ids").alias("doc_id"))
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("may"))


def _with_candidates(docs: DataFrame, rules) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with ``__may``, and for each rule whether it has to run."""
    may = materialize(candidates(docs.select("doc_id", "text"), rules), "candidates").select(F.col("doc_id").alias("__id"), F.col("may").alias("__may"))
    joined = docs.join(may, docs["doc_id"] == may["__id"], "left").drop("__id")
    lost = F.col("doc_id").isNull()
    return joined, {r.kind: F.lit(True) if trigram_query(r.pattern) == ALL else lost | F.coalesce(F.array_contains("__may", r.kind), F.lit(False)) for r in rules}


def _lengths(rule: SecretRule, needed: Column) -> Column:
    """For each match: code points before it since the last match, in it, and in the counted group."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    size = lambda x: F.length(x)
    gaps = F.transform(F.split(text, rule.pattern, -1), size)
    all_ = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), size)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), size) if rule.group else all_
    return F.when(needed & text.rlike(rule.pattern), F.arrays_zip(F.slice(gaps, 1, F.size(all_)).alias("gap"), all_.alias("len"), counted.alias("counted")))


def _matches(docs: DataFrame, rules) -> DataFrame:
    """``docs`` with ``__row`` and each rule's matches, ``__m0`` and so on, written once."""
    joined, needed = _with_candidates(docs, rules)
    cols = [_lengths(r, needed[r.kind]).cast("array<struct<gap:int,len:int,counted:int>>").alias(f"__m{i}") for i, r in enumerate(rules)]
    return joined.select(F.monotonically_increasing_id().alias("__row"), *docs.columns, *cols)


def _spans_of(found: DataFrame, rules) -> DataFrame:
    """``(__row, kind, order, start, end, counted)`` of every match that counts, in code points, end exclusive."""
    kinds = F.filter(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(i).alias("order"), F.lit(r.least).alias("least"), F.col(f"__m{i}").alias("hits")) for i, r in enumerate(rules))), lambda x: F.size(x["hits"]) > 0)
    each = found.select("__row", F.explode(kinds).alias("k")).select("__row", "k.kind", "k.order", "k.least", F.posexplode("k.hits").alias("at", "m"))
    before = W.partitionBy("__row", "order").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.len")).over(before)
    spans = each.select("__row", "kind", "order", "least", "m", end.alias("end")).filter(F.col("m.counted") >= F.col("least"))
    return spans.select("__row", "kind", "order", (F.col("end") - F.col("m.len")).alias("start"), "end", F.col("m.counted").alias("counted"))


def _spans(docs: DataFrame, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Rows ``(__row, doc_id)``, and their spans."""
    found = materialize(_matches(docs.select("doc_id", "text"), rules).drop("text"), "matches")
    return found.select("__row", "doc_id"), _spans_of(found, rules)


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, kind, start, end)``: every secret's span."""
    rows, spans = _spans(docs, rules)
    return rows.join(spans, "__row").select("doc_id", "kind", "start", "end")


def secret_report(docs: DataFrame, rules=RULES) -> DataFrame:
    rows, spans = _spans(docs, rules)
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = [i for i, r in enumerate(rules) if r.base]
    gathered = spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "order", "end", "kind"))).alias("s"))
    one = rows.join(gathered, "__row", "left").withColumn("s", F.coalesce("s", F.expr("array()").cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")))
    owned = F.filter("s", lambda x: x["order"].isin(base))
    count = lambda i: F.size(F.filter("s", lambda x: x["order"] == i)).cast("long")
    return one.select(
        "doc_id",
        *(count(i).alias(f"n_{rules[i].kind}") for i in base),
        F.sha2(F.concat_ws(",", F.transform(owned, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("s", label)).alias("spans"),
    )


def _covered(spans: DataFrame, rules) -> DataFrame:
    """``(__row, __covers)``: spans to mask as disjoint ``(start, end, kind)`` in order; of an assignment only the value goes."""
    valued = F.col("kind").isin([r.kind for r in rules if r.group])
    own = spans.select("__row", F.when(valued, F.col("end") - F.col("counted")).otherwise(F.col("start")).alias("start"), "end", "order", "kind")
    order = W.partitionBy("__row").orderBy("start", "order", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = own.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    runs = opens.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    each = runs.groupBy("__row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "order")).alias("kind"))
    return each.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("__covers"))


def mask_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the union of all secrets' spans replaced by ``[kind]`` marks; an assigned value goes, its name stays."""
    found = materialize(_matches(docs, rules), "matches", "zstd")
    some = F.lit(False)
    for i in range(len(rules)):
        some = some | F.coalesce(F.size(f"__m{i}") > 0, F.lit(False))
    covers = _covered(_spans_of(found.filter(some), rules), rules)
    # What lies between two covers is taken from the segments that it touches, so a cut costs no walk from the text's start.
    segments = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__covers", lambda c: c["end"]))
    ends = F.concat(F.transform("__covers", lambda c: c["start"]), F.array(F.length("text").cast("long")))
    marks = F.concat(F.transform("__covers", lambda c: F.concat(F.lit("["), c["kind"], F.lit("]"))), F.array(F.lit("")))
    size = F.lit(SEGMENT).cast("long")

    def kept(x: Column) -> Column:
        first = F.floor(x["a"] / size).cast("int")
        last = F.floor((x["b"] - 1) / size).cast("int")
        near = F.array_join(F.slice(F.col("__segments"), first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        piece = F.when(x["b"] > x["a"], F.substr(near, (x["a"] - first * size + 1).cast("int"), (x["b"] - x["a"]).cast("int"))).otherwise("")
        return F.concat(piece, x["mark"])

    hit = found.filter(some).join(covers, "__row", "left")
    cut = hit.withColumn("__segments", segments).withColumn("__cuts", F.arrays_zip(starts.alias("a"), ends.alias("b"), marks.alias("mark")))
    masked = cut.withColumn("text", F.when(F.col("__covers").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__cuts", kept), "")))
    return found.filter(~some).select(*docs.columns).unionByName(masked.select(*docs.columns))
