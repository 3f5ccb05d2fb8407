"""Personal data by base patterns and bootstrapped contextual extraction (DataFrame and SQL functions only).

Base matches of four kinds are seeds. The words around a seed are lexical patterns of four shapes: the word before, the two words before, the word after, and
the words on both sides. In the graph of patterns and instances a pattern's confidence is that of the instances it stands with, over all its occurrences in the corpus, and it is accepted with enough of it and enough
different uses; an unseen instance's is that of the accepted patterns it stands with, taken together (noisy or). Instances that become confident count for
patterns in the next round, so they induce patterns that no seed stands with. In the end identifier-shaped tokens with an accepted pattern are new spans.
Base spans always stay.

Offsets count code points: a match's start is the length of the gaps and matches before it, where gaps are
what ``split`` and matches what ``regexp_extract_all`` give for one pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, release, small

DOC = ["doc_id", "version"]
KINDS = ["email", "ip", "card", "phone"]
#: The patterns as asked for, written so that no run of characters is tried again from its middle: a match begins at
#: a run's start or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a text can hold no match of the kind.
FIRST = {
    "email": "contains(text, '@')",
    "ip": "text rlike '[0-9]\\\\.[0-9]'",
    "card": "text rlike '[0-9](?:[ -]?[0-9]){12}'",
    "phone": "contains(text, '+')",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) ->
    a + case when i % 2 = 1 then int(substring(reverse({_DIGITS}), i, 1))
             when int(substring(reverse({_DIGITS}), i, 1)) > 4 then 2 * int(substring(reverse({_DIGITS}), i, 1)) - 9
             else 2 * int(substring(reverse({_DIGITS}), i, 1)) end) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "forall(split(v, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(int(nullif(ltrim('0', p), '')), 0) <= 255)",
    "card": f"length({_DIGITS}) between 13 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
#: What an instance found by context must look like to be of the kind.
SHAPE = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9A-Fa-f]*[.:][0-9A-Fa-f]*[.:][0-9A-Fa-f.:]+$",
    "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$",
    "phone": r"^(?:[^0-9A-Za-z]*[0-9]){7,15}[^0-9A-Za-z]*$",
}
#: A run without white space that has a digit or @, and further runs of digits and marks after single spaces.
TOKEN = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+(?: [0-9().-]*[0-9][0-9().-]*(?!\S))*+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _placed(pattern: str, first: str, also: str = "") -> str:
    """SQL for all matches of a pattern in ``text`` with code-point spans: array of (s, e, v[, left])."""
    left = ", 'left', right(g[i], 80), 'right', left(g[i + 1], 80)" if also else ""
    kind = ", left:string,right:string" if also else ""
    item = f"named_struct('s', int(x.at + length(g[i])), 'e', int(x.at + length(g[i]) + length(m[i])), 'v', m[i]{left})"
    body = f"""aggregate(sequence(0, size(m) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,v:string{kind}>>)),
        (x, i) -> named_struct('at', int(x.at + length(g[i]) + length(m[i])), 'out', array_append(x.out, {item})), x -> x.out)"""
    q = _quoted(pattern)
    with_lists = f"transform(array(named_struct('m', regexp_extract_all(text, {q}, 0), 'g', split(text, {q}, -1))), l -> {body.replace('m[i]', 'l.m[i]').replace('g[i', 'l.g[i').replace('size(m)', 'size(l.m)')})[0]"
    empty = f"cast(array() as array<struct<s:int,e:int,v:string{kind}>>)"
    return f"case when {first} and text rlike {q} then {with_lists} else {empty} end"


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, version, text`` (a hash of the text and the text) plus ``email, ip, card, phone``: arrays of (s, e, v) of valid base matches."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    for kind in KINDS:
        valid = f"filter({{0}}, x -> exists(array(x.v), v -> {VALID[kind]}))"
        out = out.withColumn(kind, F.expr(valid.format(_placed(PATTERNS[kind], FIRST[kind]))))
    return out


def _patterns(before: str, left: str, right: str) -> str:
    """SQL for the patterns of a place, an array without nulls, from SQL for the words around it (null where there is none)."""
    return f"""filter(array(concat('< ', {left}), concat('<< ', {before}, ' ', {left}), concat('> ', {right}), concat('<> ', {left}, ' ', {right})), p -> p is not null)"""


def slots(based: DataFrame) -> DataFrame:
    """Identifier-shaped tokens with their contexts: ``doc_id, version, s, e, inst, kind, patterns, use``.

    ``kind`` is the kind of the base match that begins in the token, null for none; tokens inside a base match are left out. Words between a token and its neighbouring tokens,
    or the text's ends, make ``patterns``. ``use`` is a hash of the words around and the instance, equal for copies of a text.
    """
    found = based.select(
        *DOC, *KINDS, F.explode(F.expr(_placed(TOKEN, "text rlike '[0-9@]'", "left"))).alias("t")
    )
    inside = lambda kind: f"exists({kind}, b -> b.s < t.e and b.e > t.s)"
    begins = lambda kind: f"try_element_at(filter({kind}, b -> b.s >= t.s and b.s < t.e), 1)"
    seed = F.expr("coalesce(" + ", ".join(f"if(size({k}) > 0, {begins(k)}.v, null)" for k in KINDS) + ")")
    kind = F.expr("case " + " ".join(f"when exists({k}, b -> b.s >= t.s and b.s < t.e) then '{k}'" for k in KINDS) + " end")
    words = "filter(split(lower(t.{0}), '\\\\s+'), w -> w <> '')"
    around = f"transform(array(named_struct('l', {words.format('left')}, 'r', {words.format('right')})), x -> named_struct('l1', try_element_at(x.l, -1), 'l2', try_element_at(x.l, -2), 'r1', try_element_at(x.r, 1)))[0]"
    out = found.select(
        *DOC, F.col("t.s").alias("s"), F.col("t.e").alias("e"), F.col("t.v").alias("v"), seed.alias("seed"), kind.alias("kind"),
        F.expr(" or ".join(inside(k) for k in KINDS)).alias("inside"), F.expr(around).alias("c"),
    )
    lead = F.length(F.regexp_extract("v", r"^[^A-Za-z0-9+(]*", 0))
    core = F.regexp_extract("v", r"[A-Za-z0-9+(](?s:.*[A-Za-z0-9])?", 0)
    return out.where("kind is not null or not inside").select(
        *DOC,
        F.when(F.col("kind").isNull(), F.col("s") + lead).otherwise(F.col("s")).alias("s"),
        F.when(F.col("kind").isNull(), F.col("s") + lead + F.length(core)).otherwise(F.col("e")).alias("e"),
        F.coalesce("seed", core).alias("inst"),
        "kind",
        F.expr(_patterns("c.l2", "c.l1", "c.r1")).alias("patterns"),
        F.xxhash64("c", F.coalesce("seed", core)).alias("use"),
    )


def context_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often each of the given patterns stands around any word, over all texts."""
    words = docs.select(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+", -1), lambda w: w != "").alias("w"))
    words = words.withColumn("n", F.size("w"))
    around = "arrays_zip(concat(array(null, null), slice(w, 1, greatest(n - 2, 0))), concat(array(null), slice(w, 1, greatest(n - 1, 0))), slice(w, 2, greatest(n - 1, 0)))"
    at = words.select(F.explode(F.expr(around)).alias("c")).select(F.col("c.0").alias("l2"), F.col("c.1").alias("l1"), F.col("c.2").alias("r1"))
    parts = F.split("pattern", " ")
    # places after a word that some pattern has there, and only then the patterns themselves; words after a place are counted as words
    left = patterns.select(F.expr("case split(pattern, ' ')[0] when '<' then split(pattern, ' ')[1] when '<<' then split(pattern, ' ')[2] when '<>' then split(pattern, ' ')[1] end").alias("l1"))
    left = at.join(small(left.where("l1 is not null").distinct()), "l1", "left_semi").select(F.explode(F.expr(_patterns("l2", "l1", "cast(null as string)").replace("), p ->", ", concat('<> ', l1, ' ', r1)), p ->"))).alias("pattern"))
    left = left.join(small(patterns), "pattern", "left_semi")
    after = words.select(F.explode(F.expr("slice(w, 2, greatest(n - 1, 0))")).alias("r1"))
    right = patterns.where(parts[0] == ">").select(parts[1].alias("r1"))
    right = after.join(small(right), "r1", "left_semi").select(F.concat(F.lit("> "), "r1").alias("pattern"))
    return left.unionByName(right).groupBy("pattern").agg(F.count("*").alias("total"))


def discover(docs: DataFrame, found: DataFrame, support: int = 3, rounds: int = 5, confidence: float = 0.6) -> DataFrame:
    """``doc_id, version, kind, s, e`` of spans found by context. ``found`` is a table of :func:`slots`.

    A pattern of a kind is accepted when confident instances of the kind (seeds, and those found before) stand with it in ``support`` different uses, and are
    ``confidence`` of all that stands with it. It ends when a round accepts nothing new, after ``rounds`` rounds at most.
    """
    shape = F.expr("case of " + " ".join(f"when '{k}' then inst rlike {_quoted(SHAPE[k])}" for k in KINDS) + " end")
    cells = found.select(*DOC, "s", "e", "inst", "kind", "use", F.explode("patterns").alias("pattern")).dropDuplicates([*DOC, "s", "pattern"])
    edges = cells.groupBy("pattern", "inst", "kind", "use").agg(F.count("*").alias("n")).groupBy("pattern", "inst", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("uses"))
    edges = materialize(edges, "edges")
    often = edges.groupBy("pattern").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= support).select("pattern")
    often = materialize(often, "often")
    totals = materialize(context_counts(docs, often), "totals")
    # of each edge the kinds that its instance can be of
    graph = edges.join(small(totals), "pattern").withColumn("of", F.explode(F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.array(*map(F.lit, KINDS)))))
    graph = materialize(graph.where(F.col("kind").isNotNull() | shape).select("pattern", "total", "inst", "of", "n", "uses", F.col("kind").isNotNull().alias("seed")), "graph")
    names = [F.lit(None).cast("string").alias(c) for c in ("inst", "of")]
    known = docs.sparkSession.range(0).select(*names, F.lit(0.0).alias("conf"))
    accepted, before = None, 0
    for _ in range(rounds):
        scored = graph.join(small(known), ["inst", "of"], "left").withColumn("conf", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("conf", F.lit(0.0))))
        patterns = scored.groupBy("pattern", "of").agg(
            F.least(F.lit(1.0), F.sum(F.col("conf") * F.col("n")) / F.greatest(F.max("total"), F.sum("n"))).alias("p"),
            F.sum(F.when(F.col("conf") >= confidence, F.col("uses")).otherwise(0)).alias("uses"),
        )
        patterns = materialize(patterns.where((F.col("p") >= confidence) & (F.col("uses") >= support)).select("pattern", "of", "p"), "patterns")
        together = graph.where(~F.col("seed")).join(small(patterns), ["pattern", "of"]).groupBy("inst", "of")
        instances = materialize(together.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("conf")), "instances")
        release(*([accepted, known] if accepted is not None else []))
        accepted, known = patterns, instances
        now = accepted.count() + known.count()
        if now == before:
            break
        before = now
    unseen = cells.where("kind is null")
    best = unseen.join(small(accepted), "pattern").where(shape).groupBy(*DOC, "s", "e").agg(F.max(F.struct("p", "of")).alias("b"))
    out = materialize(best.select(*DOC, F.col("b.of").alias("kind"), "s", "e"), "discovered")
    release(edges, often, totals, graph, accepted, known)
    return out


def find_pii(docs: DataFrame, **options: float) -> DataFrame:
    """``doc_id, base, found``: arrays of (kind, s, e) in order of kind and start; ``found`` are the spans added by context.

    Null and empty texts have no spans; a null ``doc_id`` is an id like any other; rows that share an id have the spans of their own texts, repeated rows the same. Whole texts of any length are searched.
    Of kinds that are equally confident for a token the last by name is taken. With no seeds nothing is added; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    based = base_spans(docs)
    order = {k: i for i, k in enumerate(KINDS)}
    every = F.expr("concat(" + ", ".join(f"transform({k}, x -> named_struct('k', {order[k]}, 's', x.s, 'e', x.e))" for k in KINDS) + ")")
    held = materialize(slots(based), "slots")
    extra = discover(docs, held, **options)
    number: Column = F.expr("case kind " + " ".join(f"when '{k}' then {i}" for k, i in order.items()) + " end")
    extra = extra.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(F.array_sort(F.collect_set(F.struct(number.alias("k"), "s", "e"))).alias("found"))
    base = based.select(*DOC, F.array_sort(every).alias("base"))
    out = base.join(small(extra), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    release(held)
    return out.select("doc_id", "base", F.coalesce("found", F.expr("cast(array() as array<struct<k:int,s:int,e:int>>)")).alias("found"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and how many spans were found by context (``n_found``) and in all (``n_spans``)."""
    out = find_pii(read(spark, sf_dir, "documents"))
    name = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    text = "array_join(transform({}, x -> concat({}[x.k], ':', x.s, ':', x.e)), ',')"
    return out.select(
        "doc_id",
        *(F.expr(f"bigint(size(filter(base, x -> x.k = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.expr(text.format("base", name)), 256).alias("base_sha256"),
        F.expr(text.format("array_sort(array_distinct(concat(base, found)))", name)).alias("spans"),
        F.expr("bigint(size(found))").alias("n_found"),
        F.expr("bigint(size(array_distinct(concat(base, found))))").alias("n_spans"),
    )
