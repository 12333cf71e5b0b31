"""Secret scanning with multipart credential linking.

Strong candidates are reported as they are: values assigned to a telling name,
access identifiers with a fixed lead, long hexadecimal runs. Weak candidates say
little alone: identifiers (a user, client or account name that is assigned),
secrets (a short value assigned to a telling name, a token of 32 to 88 characters
with digits and letters of both cases) and endpoints (addresses of services). They are reported only with
their complement inside one scope, ``SCOPE`` code points of the same document:
an identifier with a secret, a secret with an identifier or an endpoint, an
endpoint with both. The parts are joined as intervals, by buckets of a scope's
length; a part has a minimum length, so a bucket holds a bounded number of them.

Everything is expressions and joins: matches come from splitting a text at the
matches, which gives their places; a plain substring test spares most texts the
costly patterns. Texts are read once and reduced to their parts, which are cut in
the shared folder before they are linked.

Defined cases: a null text counts as empty; of one kind, matches are leftmost and
do not overlap, of different kinds they may; rows repeated with one identifier
and text get the same spans each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockcast.llm.common import cut, whole

SCOPE = 256

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{16,}"
USER = r"""((?i:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
TOKEN = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._-]{3,}"

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")


BLOCK = 256
PLACES = "array<struct<s:int,e:int,v:int>>"


def steps(text: Column, pattern: str, value_group: int = 0, value=F.length) -> Column:
    """Array of (length before, length, value) of the leftmost matches: what a split leaves lies between two of them."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    both = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    return F.filter(F.zip_with(both, values, lambda x, v: F.struct(x["p"].alias("p"), x["m"].alias("m"), value(v).alias("v"))), lambda x: x["m"].isNotNull())


def places(found: Column) -> Column:
    """Array of (start, end, value) from ``steps``: sums run over blocks first and inside each block then, so that many matches stay cheap."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(found) / BLOCK).cast("int") - 1)), lambda b: F.slice(found, b * BLOCK + 1, F.lit(BLOCK))
    )
    wide = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda n, x: n + x["p"] + x["m"]).alias("n")))
    starts = F.aggregate(
        wide, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:array<struct<p:int,m:int,v:int>>,at:int>>").alias("out")),
        lambda acc, w: F.struct((acc["at"] + w["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(w["b"].alias("b"), acc["at"].alias("at")))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(starts, lambda w: F.aggregate(
        w["b"], F.struct(w["at"].alias("at"), F.array().cast(PLACES).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["p"] + x["m"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["p"]).alias("s"), (acc["at"] + x["p"] + x["m"]).alias("e"), x["v"].alias("v")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )))


def mentions(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def mixed(value: Column) -> Column:
    """Length of a token with digits and letters of both cases, else 0."""
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]"), F.length(value)).otherwise(0)


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, one array per kind): the only pass over the texts. ``key`` tells texts of one identifier apart."""
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("t")).withColumn("low", F.lower("t"))
    t, low = F.col("t"), F.col("low")
    none = F.array().cast("array<struct<p:int,m:int,v:int>>")
    telling = mentions(low, "password", "passwd", "secret", "token", "apikey", "api_key")
    found = base.select(
        "id", F.xxhash64(t, F.length(t)).alias("key"),
        F.when(telling, steps(t, ASSIGN, 2)).otherwise(none).alias("assigned"),
        F.when(F.contains(t, F.lit("AKIA")), steps(t, ACCESS)).otherwise(none).alias("access"),
        F.when(F.rlike(t, F.lit("[0-9a-f]{16}")), steps(t, HEX_LONG)).otherwise(none).alias("hex"),
        F.when(mentions(low, "user", "login", "account", "client", "access"), steps(t, USER)).otherwise(none).alias("identifier"),
        F.when(F.rlike(t, F.lit("[A-Za-z0-9+/_-]{32}")), steps(t, TOKEN, value=mixed)).otherwise(none).alias("token"),
        F.when(F.contains(t, F.lit("://")), steps(t, ENDPOINT)).otherwise(none).alias("endpoint"),
    )
    placed = found.select("id", "key", *[places(F.col(c)).alias(c) for c in ("assigned", "access", "hex", "identifier", "token", "endpoint")])
    long_enough = lambda c, least, most=2**31 - 1: F.filter(F.col(c), lambda x: (x["v"] >= least) & (x["v"] <= most))
    return placed.select(
        "id", "key", long_enough("assigned", 12).alias("assign"), long_enough("access", 18).alias("access"), "hex", "identifier",
        F.concat(long_enough("assigned", 6, 11), long_enough("token", 32, 88)).alias("secret"), "endpoint",
    )


def of_kind(kind: str) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), number.alias("k"), x["e"].alias("e")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, base (array of kind, start, end by start and kind), spans (base and linked ones)."""
    found, _ = cut(parts(docs, id_col, text_col))
    numbered = F.concat(*[of_kind(k) for k in KINDS])
    flat = found.select("id", "key", F.explode(numbered).alias("p")).select("id", "key", "p.*").distinct()
    flat, _ = cut(flat)
    role = F.when(F.col("k").isin(0, 2, 4), "S").when(F.col("k").isin(1, 3), "I").otherwise("E")
    spots = flat.withColumns({"role": role, "bucket": F.expr(f"s div {scope}")})
    weak = spots.filter("k >= 3")
    # a part is in the buckets its start and end lie in and all between; what is within a scope of it starts at most one bucket away
    reach = F.explode(F.sequence(F.expr(f"(s div {scope}) - 1"), F.expr(f"(e div {scope}) + 1")))
    wide = weak.select("id", "key", "s", "k", "e", "role", reach.alias("bucket"))
    others = spots.select(
        F.col("id").alias("oid"), F.col("key").alias("okey"), F.col("s").alias("os"), F.col("e").alias("oe"), F.col("role").alias("orole"),
        F.explode(F.sequence(F.expr(f"s div {scope}"), F.expr(f"e div {scope}"))).alias("obucket"),
    )
    close = wide.join(
        others,
        F.col("id").eqNullSafe(F.col("oid")) & (F.col("key") == F.col("okey")) & (F.col("bucket") == F.col("obucket"))
        & (F.col("role") != F.col("orole")) & (F.col("os") <= F.col("e") + scope) & (F.col("s") <= F.col("oe") + scope)
        & ((F.col("os") >= F.col("e")) | (F.col("oe") <= F.col("s"))),
    )
    met = close.groupBy("id", "key", "s", "k", "e", "role").agg(
        F.max((F.col("orole") == "S").cast("int")).alias("with_s"), F.max((F.col("orole") == "I").cast("int")).alias("with_i"), F.max((F.col("orole") == "E").cast("int")).alias("with_e"))
    linked = met.filter("(role = 'I' AND with_s = 1) OR (role = 'S' AND with_i + with_e > 0) OR (role = 'E' AND with_s + with_i = 2)").groupBy("id", "key").agg(
        F.collect_list(F.struct("s", "k", "e")).alias("more")).withColumnsRenamed({"id": "lid", "key": "lkey"})
    base = F.array_sort(F.concat(*[of_kind(k) for k in KINDS[:3]]))
    joined = found.select("id", "key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base")).join(
        linked, F.col("id").eqNullSafe(F.col("lid")) & (F.col("key") == F.col("lkey")), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return joined.select("id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
