"""Secrets in texts, with multipart credentials linked by an interval join.

Some spans are secrets by themselves (`assign`, `access`, `hex`). Others only look like part
of a credential: an account name, a random-looking token, an address. Such weak candidates
are reported when the parts that complete them lie within SCOPE characters:

    ident      with a secret (assign, hex, token) in its scope
    token      with an identifier (access, ident) in its scope
    endpoint   with both in its scope

A part completes another one only if they do not overlap, so nothing completes itself: not the
value of an identifier, nor what stands inside an address. What is inside an address is no
token, and neither is a UUID, a path of words, or a run of few different characters.

Parts become intervals, known by the bins of SCOPE characters in which they begin and end.
A part after another one begins, and one before it ends, in one of two bins. Identifiers and
secrets are reduced to one row per text and bin before the join, so a text full of them costs
its length, not the square of their number; only texts with parts take part, and no text is
shuffled.

NULL counts as an empty text. Repeated rows give repeated results. All positions are code
points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilode.llm.common import fingerprint, let, stored, total

SCOPE = 200
MASK = "[SECRET]"

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

IDENT = r"""(?i:user_?name|user_?id|login|client_?id|account_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
TOKEN = r"[A-Za-z0-9+/_-]{32,}={0,2}"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
# A random token goes from one kind of character to another at least so often, and has so many different ones.
CHANGE = "(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]"
MIN_CHANGES, MIN_DIFFERENT = 8, 14
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""

# In the order in which kinds that start together are listed.
KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
BASE = 3
SPAN = "array<struct<start:int,rank:int,end:int>>"
_BLOCK = 512


def _sums_before(values: Column) -> Column:
    """For each value the sum of those before it, block by block to keep long arrays cheap."""

    def within(block: Column) -> Column:
        zero = F.array(F.lit(0))
        return F.aggregate(block, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def joined(blocks: Column) -> Column:
        offsets = within(F.transform(blocks, lambda b: total(b).cast("int")))
        return F.flatten(
            F.transform(blocks, lambda b, k: F.transform(F.slice(within(b), 1, F.size(b)), lambda x: x + F.get(offsets, k)))
        )

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_BLOCK))
    return let(F.transform(starts, lambda s: F.slice(values, s, _BLOCK)), joined)


def found(text: Column, pattern: str, needed: str, rank: int, keep=None) -> Column:
    """Spans of the leftmost matches that do not overlap and that `keep` accepts.

    A match starts after the gaps and matches before it, so lengths are all that is needed.
    Texts without a match of `needed` are left at once.
    """

    def spans(gaps: Column, matches: Column) -> Column:
        steps = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        ends = let(steps, lambda s: let(_sums_before(s), lambda b: F.zip_with(b, s, lambda x, y: x + y)))
        # The last gap has no match after it.
        rows = F.zip_with(
            F.slice(ends, 1, F.size(matches)),
            matches,
            lambda e, m: F.struct(
                (e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), m.alias("match")
            ),
        )
        kept = rows if keep is None else F.filter(rows, lambda r: keep(r["match"]))
        return F.transform(kept, lambda r: F.struct(r["start"], r["rank"], r["end"]))

    held = let(
        F.split(text, pattern, -1),
        lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: spans(gaps, m)),
    )
    return F.when(F.rlike(text, F.lit(needed)), held).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _random(token: Column) -> Column:
    """Whether a token looks drawn at random."""
    kinds = [F.rlike(token, F.lit(f"[{kind}]")) for kind in ("a-z", "A-Z", "0-9")]
    return (
        kinds[0] & kinds[1] & kinds[2]
        & ~F.contains(token, F.lit("://"))
        & ~F.rlike(token, F.lit(UUID))
        & (F.regexp_count(token, F.lit(CHANGE)) >= MIN_CHANGES)
        & (F.size(F.array_distinct(F.split(token, ""))) >= MIN_DIFFERENT)
    )


def parts(text: Column) -> list[Column]:
    """Spans of each of KINDS, weak candidates that repeat a base span left out."""
    assign = found(
        text, ASSIGN, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGNED
    )
    access = found(text, ACCESS, ACCESS, 1, lambda m: F.length(m) >= MIN_ACCESS)
    # A run of at least that many characters is the same run that a shorter pattern finds.
    hexes = found(text, f"[0-9a-f]{{{MIN_HEX},}}", f"[0-9a-f]{{{MIN_HEX}}}", 2)
    ident = found(text, IDENT, IDENT, 3)
    # An address is matched as a whole first, so that what it holds is no token.
    token = found(text, f"{ENDPOINT}|{TOKEN}", TOKEN, 4, _random)
    endpoint = found(text, ENDPOINT, "://", 5)
    return [assign, access, hexes, ident, token, endpoint]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key of the row's text, and one array of spans per kind."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), fingerprint(F.col("text"))).alias("key"),
        *[spans.alias(kind) for kind, spans in zip(KINDS, parts(text))],
    )


def _rank(column: str, *kinds: str) -> Column:
    return F.col(column).isin(*[KINDS.index(k) for k in kinds])


def linked(rows: DataFrame) -> DataFrame:
    """key and the weak spans whose complementary parts co-occur, by an interval join.

    Of the parts that begin in the bin where a span ends, the last one decides whether any is after the
    span; of those in the next bin, the first one whether any is in its scope. Before the span
    it is the other way round.
    """
    every = F.flatten(F.array(*KINDS))
    part = (
        rows.where(F.size("ident") + F.size("token") + F.size("endpoint") > 0)
        .dropDuplicates(["key"])
        .select("key", F.explode(every).alias("part"))
        .select("key", "part.*")
    )
    identifier, secret = _rank("rank", "access", "ident"), _rank("rank", "assign", "hex", "token")
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("at")) for side in ("start", "end")]))
    bins = (
        part.where(identifier | secret)
        .select("key", "rank", ends.alias("edge"))
        .select("key", "rank", "edge.*", F.floor(F.col("edge.at") / SCOPE).alias("bin"))
        .groupBy("key", "side", "bin")
        .agg(
            F.min(F.when(identifier, F.col("at"))).alias("id_from"),
            F.max(F.when(identifier, F.col("at"))).alias("id_to"),
            F.min(F.when(secret, F.col("at"))).alias("secret_from"),
            F.max(F.when(secret, F.col("at"))).alias("secret_to"),
        )
    )
    # Bins in which parts after the span begin, and parts before it end.
    after, before = F.floor(F.col("end") / SCOPE), F.floor(F.col("start") / SCOPE)
    wanted = [("start", after), ("start", after + 1), ("end", before), ("end", before - 1)]
    wanted = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), at.alias("bin")) for side, at in wanted]))
    probes = part.where(F.col("rank") >= BASE).select("*", wanted.alias("wanted")).select("key", "start", "rank", "end", "wanted.*")

    def near(name: str) -> Column:
        first, last = F.col(f"{name}_from"), F.col(f"{name}_to")
        later = F.when(F.col("bin") == after, last >= F.col("end")).otherwise(first <= F.col("end") + SCOPE)
        earlier = F.when(F.col("bin") == before, first <= F.col("start")).otherwise(last >= F.col("start") - SCOPE)
        return F.bool_or(F.coalesce(F.when(F.col("side") == "start", later).otherwise(earlier), F.lit(False)))

    judged = (
        probes.join(bins, ["key", "side", "bin"])
        .groupBy("key", "start", "rank", "end")
        .agg(near("id").alias("by_id"), near("secret").alias("by_secret"))
    )
    complete = (
        (_rank("rank", "ident") & F.col("by_secret"))
        | (_rank("rank", "token") & F.col("by_id"))
        | (_rank("rank", "endpoint") & F.col("by_id") & F.col("by_secret"))
    )
    return (
        judged.where(complete)
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "rank", "end")).alias("weak"))
    )


def _spans(kinds: list[str]) -> Column:
    return F.sort_array(F.flatten(F.array(*kinds)))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
    )


def _resolved(docs: DataFrame) -> DataFrame:
    """`scanned` with `base` and all reported spans, sorted."""
    rows = stored(scanned(docs), "secret-parts")
    return rows.join(linked(rows), "key", "left").select(
        "doc_id",
        "key",
        *KINDS,
        _spans(["assign", "access", "hex"]).alias("base"),
        _spans(["assign", "access", "hex", F.coalesce("weak", F.array().cast(SPAN))]).alias("spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row of `docs`."""
    return _resolved(docs).select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping ones, replaced by MASK."""

    def step(done: Column, span: Column) -> Column:
        before = F.substring(text, done["to"] + 1, F.greatest(span["start"] - done["to"], F.lit(0)))
        mask = F.when(span["start"] >= done["to"], F.lit(MASK)).otherwise("")
        return F.struct(
            F.concat(done["pieces"], F.array(before, mask)).alias("pieces"),
            F.greatest(done["to"], span["end"]).alias("to"),
        )

    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("to"))
    tail = lambda done: F.concat(F.array_join(done["pieces"], ""), F.substring(text, done["to"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with the same rows and columns, reported spans masked in the text."""
    found_ = (
        _resolved(docs)
        .where(F.size("spans") > 0)
        .select(F.col("key").alias("__llm_key"), F.col("spans").alias("__llm_spans"))
        .dropDuplicates(["__llm_key"])
    )
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), fingerprint(F.col("text")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    hidden = F.when(F.col("__llm_spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__llm_spans")))
    joined = docs.withColumn("__llm_key", key).join(found_, "__llm_key", "left")
    return joined.select(*kept, hidden.alias("text")).select(*[F.col(f"`{c}`") for c in docs.columns])
