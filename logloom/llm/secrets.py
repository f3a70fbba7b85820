"""Credentials in texts, judged by who else has them.

Candidates are assigned values, access keys and long hexadecimal numbers, and bare runs of letters and
digits that may be the same secret without its name. Every candidate value is counted over the corpus
by distinct owners and distinct repositories. A value of ``COMMON_OWNERS`` owners or more is a widely
copied example; the others look live. A bare run counts as a secret only if its value is a live-looking
candidate of another kind somewhere in the corpus.

All spans are in code points, end exclusive, found left to right without overlap within a kind. Null
texts count as empty and have no span. A null owner is one owner, a null repository one repository.
Repeated rows are judged alike. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import materialize

COMMON_OWNERS = 3
PLACEHOLDER = "<SECRET>"

# Kinds in their order: pattern, group with the value, its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "bare": (r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]{0,40}+[0-9])[A-Za-z0-9+/_.=-]{12,}+", 0, 12),
}
BASE = ("assign", "access", "hex")
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, kind: str) -> Column:
    """Array of struct(start, kind, end, value): all matches of a kind that are long enough.

    Between two matches lies one piece of the text split at the pattern, so lengths give the places.
    """
    pattern, group, least = KINDS[kind]
    number = list(KINDS).index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(between, F.lit(1), F.size(whole)).alias("b"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["v"].alias("value"))
        kept = F.when(F.length(x["v"]) >= least, F.array(span)).otherwise(F.array().cast(_SPAN))
        return F.struct(end.alias("at"), F.concat(state["found"], kept).alias("found"))

    found = F.aggregate(steps, empty, step, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> Column:
    """All spans of a text by start, then kind; bare ones only where no other lies."""
    base = F.concat(*[matches(text, kind) for kind in BASE])
    bare = F.filter(matches(text, "bare"), lambda b: b["value"].rlike("[A-Za-z]"))
    return F.transform(F.array(base), lambda own: F.array_sort(F.concat(own, F.filter(bare, lambda b: ~F.exists(own, lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"]))))))[0]


def has_candidate(text: Column) -> Column:
    seen = text.rlike(KINDS["assign"][0])
    for kind in ("access", "hex", "bare"):
        seen = seen | text.rlike(KINDS[kind][0])
    return F.coalesce(seen, F.lit(False))


def verdicts(found: DataFrame, common_owners: int = COMMON_OWNERS) -> DataFrame:
    """Per candidate value (a digest): owners, repositories, example, secret.

    ``found`` has row, owner, repository and spans. Counts are of distinct pairs, so that a value in
    very many rows is combined before it is shuffled.
    """
    each = found.select("owner", "repository", F.explode("spans").alias("s")).select(
        "owner", "repository", F.md5("s.value").alias("value"), (F.col("s.kind") < len(BASE)).cast("int").alias("named")
    )
    owners = each.groupBy("value", "owner").agg(F.max("named").alias("named"))
    owners = owners.groupBy("value").agg(F.count("*").alias("owners"), F.max("named").alias("named"))
    repositories = each.groupBy("value", "repository").agg(F.count("*").alias("n"))
    repositories = repositories.groupBy("value").agg(F.count("*").alias("repositories"))
    example = F.col("owners") >= common_owners
    return owners.join(repositories, "value").select(
        "value", "owners", "repositories", example.alias("example"), ((F.col("named") == 1) & ~example).alias("secret")
    )


def judged(found: DataFrame, common_owners: int = COMMON_OWNERS) -> DataFrame:
    """Per row with candidates: the spans with their verdicts, those of bare runs only if secret.

    ``found`` has row, owner, repository and spans and is read several times: give a stored table.
    """
    each = found.select("row", F.explode("spans").alias("s")).select(
        "row", "s.start", "s.kind", "s.end", F.md5("s.value").alias("value")
    )
    known = each.join(verdicts(found, common_owners), "value").where(f"kind < {len(BASE)} OR secret")
    span = F.struct("start", "kind", "end", "secret", "example", "owners", "repositories")
    return known.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("judged"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, owner: Column, repository: Column, common_owners: int = COMMON_OWNERS) -> DataFrame:
    """Per row: doc_id, spans (as found, by kind BASE and bare) and judged (with verdicts; null if none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", owner.alias("owner"), repository.alias("repository"), text.alias("_text"))
    found = found.select("doc_id", "owner", "repository", candidates(F.col("_text")).alias("spans"))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    return found.select("doc_id", "row", "spans").join(judged(found, common_owners), "row", "left").drop("row")


def span_digests(docs: DataFrame, owner: Column, repository: Column, common_owners: int = COMMON_OWNERS) -> DataFrame:
    """Counts and digests of the spans of ``secret_spans``."""
    found = secret_spans(docs, owner, repository, common_owners)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(kind: str) -> Column:
        number = list(KINDS).index(kind)
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    every = F.coalesce("judged", F.array().cast("array<struct<start:int,kind:int,end:int,secret:boolean,example:boolean,owners:long,repositories:long>>"))
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size(F.filter(every, lambda s: s["secret"])).cast("long").alias("n_live"),
        F.size(F.filter(every, lambda s: s["example"])).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, owner: Column, repository: Column, common_owners: int = COMMON_OWNERS) -> DataFrame:
    """``docs`` with every live-looking secret in ``text`` replaced by PLACEHOLDER.

    Overlapping secrets become one placeholder; examples stay. A column ``n_chars`` follows the text.
    Texts without a candidate pass by untouched and unshuffled.
    """
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = has_candidate(F.col("text"))
    hits = docs.where(seen).select(
        F.struct(*columns).alias("_row"), owner.alias("owner"), repository.alias("repository"), candidates(text).alias("spans")
    )
    hits = materialize(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    live = judged(hits, common_owners).select("row", F.filter("judged", lambda s: s["secret"]).alias("live"))
    old = F.col("_row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = old.substr(state["at"] + 1, s["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], between, F.lit(PLACEHOLDER))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    new = F.aggregate("live", start, cut, lambda state: F.concat(state["out"], old.substr(state["at"] + 1, F.length(old))))
    new = F.when(F.size("live") > 0, new).otherwise(old)
    rewritten = hits.join(live, "row", "left").select("_row", F.when(F.col("live").isNull(), old).otherwise(new).alias("_new"))
    changed = F.col("_new") != F.col("_row.text")
    values = {c: F.col(f"_row.`{c}`") for c in columns}
    values["text"] = F.col("_new")
    if "n_chars" in values:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(changed, F.length("_new").cast(kind)).otherwise(values["n_chars"])
    return docs.where(~seen).unionByName(rewritten.select(*[v.alias(c) for c, v in values.items()]))
