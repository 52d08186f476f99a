"""Operator 8 [native]: secret scans over a trigram inverted index.

Every rule's regex is turned, on the driver, into a Boolean query over trigrams
of the lower-cased text: an OR of alternatives, each an AND of the trigrams of a
literal that a match must hold.  A rule without such trigrams scans fully.

1. One linear pass lists, per document, which of the rules' trigrams it holds;
   exploded, these are the postings (trigram, document) of an inverted index that
   is restricted to the vocabulary of the queries.
2. Postings are intersected: per document and alternative, the OR of one bit per
   trigram must cover the alternative.  Partial aggregation makes that map-side.
3. Only (document, rule) pairs that come out are verified by the regex itself,
   which gives exact spans.

All of it is DataFrame functions; there is no Python on the executors.

Candidates are (document, rules) rows in the shared folder; a sieve of bounded size
tells which texts may be theirs, and only those are moved to meet their rules.

Spans are in code points, end exclusive.  Null text: empty, so no spans.  A
repeated doc_id: each row is verified on its own text (the rows share candidates,
which can only add checks).  A null doc_id is a value like any other.  Empty
table or no rules: no spans.  Very long texts are scanned whole.  Equal rows are
scanned each.  Matches of one kind never overlap; those of two kinds may.  Columns
of ``docs`` whose names the scan uses itself are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallforge.llm import _io


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # [0-9a-f]+ of 32 and more: such a run is one match either way
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What the method adds to the base rules.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE
MOST_LITERALS = 64


def regex_tree(pattern: str) -> list[tuple[str, object]]:
    """The parsed pattern as (operation, argument) pairs, by the parser of ``re``: it
    is no public interface, so the shapes that ``literals`` relies on are tested."""
    from re import _parser

    return list(_parser.parse(pattern))


def literals(pattern: str) -> list[frozenset[str]]:
    """The mandatory literal groups of a regex: of each, a match holds one."""
    groups: list[frozenset[str]] = []

    def run(nodes, at: frozenset[str]) -> frozenset[str]:
        """Literals that end at this place, given those that led here."""
        for op, arg in nodes:
            op = str(op)
            if op == "LITERAL":
                at = frozenset(s + chr(arg).lower() for s in at)
            elif op == "SUBPATTERN":
                at = run(arg[3], at)
            elif op == "BRANCH":
                ends = [alone(x) for x in arg[1]]
                if None in ends:
                    at = flush(at)
                else:
                    at = frozenset(a + b for a in at for e in ends for b in e)
            elif op == "IN" and len(arg) <= 8 and all(str(x[0]) == "LITERAL" for x in arg):
                at = frozenset(s + chr(x[1]).lower() for s in at for x in arg)
            elif op == "MAX_REPEAT" and arg[:2] == (0, 1) and len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL":
                at = at | frozenset(s + chr(arg[2][0][1]).lower() for s in at)
            else:
                at = flush(at)
            if len(at) > MOST_LITERALS:
                at = flush(at)
        return at

    def alone(nodes) -> frozenset[str] | None:
        nonlocal groups
        kept, groups = groups, []
        end, whole = run(nodes, frozenset([""])), groups == []
        groups = kept
        return end if whole else None

    def flush(at: frozenset[str]) -> frozenset[str]:
        if at != {""}:
            groups.append(at)
        return frozenset([""])

    flush(run(regex_tree(pattern), frozenset([""])))
    return groups


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams that every match implies; empty: no such query."""
    best: list[frozenset[str]] = []
    for group in literals(pattern):
        ands = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in group]
        ands = [a for a in set(ands) if not any(b < a for b in ands)]
        if all(ands) and (not best or (min(map(len, ands)), -len(ands)) > (min(map(len, best)), -len(best))):
            best = ands
    return sorted(best, key=sorted)


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in s)


def _postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram), from one pass of a look-ahead over each text; the
    trigrams stand in a prefix tree, so most places fail at one class."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in trigrams:
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    heads = "|".join(
        _quote(a) + "(?:" + "|".join(_quote(b) + "[" + "".join(map(_quote, c)) + "]" for b, c in sorted(seconds.items())) + ")" for a, seconds in sorted(tree.items())
    )
    first = "[" + "".join(map(_quote, sorted(tree))) + "]"
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"(?={first})(?=({heads}))"), F.lit(1))
    return docs.select("doc_id", F.explode(F.array_distinct(found)).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, _rules: the numbers of the rules whose trigram query holds."""
    rows = []
    for k, rule in enumerate(rules):
        for alternative, need in enumerate(trigram_query(rule.pattern)):
            for bit, t in enumerate(sorted(need)):
                rows.append((k, alternative, t, 1 << bit, (1 << len(need)) - 1))
    if not rows:  # every rule scans fully
        return docs.select("doc_id", F.array().cast("array<int>").alias("_rules")).limit(0)
    quoted = ", ".join(f"({k}, {a}, '{t.replace(chr(39), chr(39) * 2)}', {bit}L, {full}L)" for k, a, t, bit, full in rows)
    query = docs.sparkSession.sql(f"SELECT * FROM VALUES {quoted} AS q(rule, alternative, trigram, bit, full)")
    postings = _postings(docs, sorted({r[2] for r in rows}))
    return (
        postings.join(F.broadcast(query), "trigram")  # at most a few hundred rows, from the rules alone
        .groupBy("doc_id", "rule", "alternative", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
        .groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("_rules"))
    )


def prefix_sums(x: Column, block: int = 128) -> Column:
    """Exclusive prefix sums of an int array, by blocks: the sum of the blocks
    before, and of what stands before in the block.  A text with very many matches
    costs far less than the square of their number."""
    add = lambda a, b: a + b
    zero = F.lit(0).cast("int")
    firsts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(block))
    start = F.struct(zero.alias("sum"), F.array().cast("array<int>").alias("all"))
    blocks = F.transform(firsts, lambda i: F.slice(x, i, block))
    # fold over blocks: each appends its own running sums, so a block copies once
    within = lambda b, base: F.transform(b, lambda _, i: base + F.aggregate(F.slice(b, 1, i), zero, add))
    step = lambda acc, b: F.struct(F.aggregate(b, acc["sum"], add).alias("sum"), F.concat(acc["all"], within(b, acc["sum"])).alias("all"))
    return F.aggregate(blocks, start, step, lambda acc: acc["all"])


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: array<struct<start, rank, end, kind>>,
    sorted by start, then by the order of the rules."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("secret_spans", "_rules", "_test", "_match", "_step", "_place", "_id", "_key", "_maybe", "_salt", "_hot", "_at", "_word", "_bits", "_n")])
    none = F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    if not rules:
        return docs.withColumn("secret_spans", F.array().cast(_SPANS))
    ids = _io.written(candidates(docs.select("doc_id", "text"), rules).withColumnRenamed("doc_id", "_id"), "candidates")
    # texts that are surely no candidates stay where they are
    marked = _io.sifted(docs, "doc_id", _io.sieve(ids, "_id"))
    some = marked.where("_maybe").drop("_maybe")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    some = some.withColumn("_key", key("doc_id"))
    sizes = some.groupBy("_key").agg(F.count("*").alias("_n"))
    hot = _io.hot_keys(sizes, "_key", "_n", docs.count())  # a doc_id of very many rows
    rows = _io.salted_join(some, ids.select(key("_id").alias("_key"), "_rules"), "_key", hot, ["text"], "left").drop("_key")
    rows = rows.unionByName(marked.where("not _maybe").drop("_maybe").withColumn("_rules", F.lit(None).cast("array<int>")))
    tests = [text.rlike(r.pattern) if not trigram_query(r.pattern) else F.coalesce(F.array_contains("_rules", k), F.lit(False)) & text.rlike(r.pattern) for k, r in enumerate(rules)]
    rows = _io.held(rows, "_test", F.struct(*[t.alias(f"t{k}") for k, t in enumerate(tests)]))
    match = []
    for k, rule in enumerate(rules):
        take = lambda x, k=k: F.when(F.col(f"_test.t{k}"), x).otherwise(none)
        match += [
            take(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias(f"whole{k}"),
            take(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias(f"kept{k}"),
            take(F.split(text, rule.pattern, -1)).alias(f"gaps{k}"),
        ]
    # each step is computed once per row: matches, running lengths, spans
    rows = _io.held(rows, "_match", F.struct(*match))
    part = lambda name, k: F.col(f"_match.{name}{k}")

    def steps(k: int) -> Column:
        return F.transform(part("whole", k), lambda m, i: F.length(m) + F.length(F.get(part("gaps", k), i)))

    rows = _io.held(rows, "_step", F.struct(*[steps(k).alias(f"s{k}") for k in range(len(rules))]))
    rows = _io.held(rows, "_place", F.struct(*[prefix_sums(F.col(f"_step.s{k}")).alias(f"p{k}") for k in range(len(rules))]))
    found = F.concat(*[_spans(part, k, rule) for k, rule in enumerate(rules)])
    return _io.held(rows, "secret_spans", F.array_sort(found)).drop("_rules", "_test", "_match", "_step", "_place")


def _spans(part, k: int, rule: Rule) -> Column:
    """The spans of rule k whose measured group is long enough."""

    def span(m: Column, i: Column) -> Column:
        start = F.get(F.col(f"_place.p{k}"), i) + F.length(F.get(part("gaps", k), i))
        return F.struct(start.alias("start"), F.lit(k).alias("rank"), (start + F.length(m)).alias("end"), F.lit(rule.kind).alias("kind"))

    def long_enough(_: Column, i: Column) -> Column:
        return F.length(F.get(part("kept", k), i)) >= rule.least

    return F.filter(F.transform(part("whole", k), span), long_enough).cast(_SPANS)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_joined(F.filter(spans, lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span masked (overlapping spans as one), n_chars
    (where it is a column) renewed for changed texts; all rows and columns stay."""
    # merge overlapping spans, then stitch what lies between: both linear folds
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    text = F.col("text")
    stitched = F.aggregate(
        "secret_spans",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["done"]).alias("done"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    rows, own = _io.apart(docs, "doc_id", "text", "n_chars")
    hit = F.size("secret_spans") > 0
    out = scan(rows, rules).withColumn("_masked", F.when(hit, stitched).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("_masked")).select(*own)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(_io.table(spark, sf_dir, "documents").select("doc_id", "text")))


_SQL_PATTERNS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
] + [(r.kind, r.pattern, 0, 1) for r in MORE]


def _sql() -> str:
    """For each rule: matches, the text between them, running offsets."""
    parts = []
    for rank, (kind, p, group, least) in enumerate(_SQL_PATTERNS):
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, k, m, v, length(m) AS n, length(b) AS gap FROM (
    SELECT doc_id, unnest(range(len(mm))) AS k, unnest(mm) AS m, unnest(vv) AS v, unnest(bb[:len(mm)]) AS b FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS mm, regexp_extract_all(t, '{p}', {group}) AS vv, regexp_split_to_array(t, '{p}') AS bb FROM d))
  QUALIFY true""")
    least = " ".join(f"WHEN {rank} THEN {least}" for rank, (_, _, _, least) in enumerate(_SQL_PATTERNS))
    union = " UNION ALL ".join(x.replace("  QUALIFY true", "") for x in parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({union}),
placed AS (
  SELECT doc_id, rank, kind, n, v, CAST(sum(gap + n) OVER (PARTITION BY doc_id, rank ORDER BY k) - n AS BIGINT) AS s FROM m),
kept AS (SELECT doc_id, rank, s, kind, kind || ':' || s || ':' || (s + n) AS span FROM placed WHERE length(v) >= CASE rank {least} END),
g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
