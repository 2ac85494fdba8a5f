"""Secret scanning with multipart credential linking.

Strong patterns give the base findings. Weak candidates (an access
identifier, a secret or an endpoint that says little on its own) are
reported only when complementary parts stand beside them, with a gap of at
most ``reach`` characters, in one scope, found by an interval join over positions.
All of it is built from Spark's own string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.llm.common import apart, bind, cut


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join([_any_case("password"), _any_case("passwd"), _any_case("secret"), _any_case("token"), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = f"({KEYWORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind -> (pattern, least characters of the match, or of group 2 for assign)
BASE = {"assign": (ASSIGN, 8), "access": ("AKIA[A-Z0-9]+", 16), "hex": ("[0-9a-f]{32,}", 32)}
#: Weak parts by role: an identifier, a secret and an endpoint complete each other. An endpoint's scheme
#: counts by its last 20 letters, so that a long run of letters takes linear time.
IDENTIFIER = "(" + "|".join(_any_case(w) for w in ("username", "user", "login", "client_id", "account")) + ")[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
WEAK = {"identifier": (IDENTIFIER, 1), "opaque": ("[A-Za-z0-9+/_-]{20,}", 20), "endpoint": ("[a-z][a-z0-9+]{0,19}://[A-Za-z0-9_.-]+(:[0-9]+)?[A-Za-z0-9/_.-]*", 8)}
#: What a weak kind needs beside it: a kind of another role, weak or base.
ROLE = {"identifier": "id", "access": "id", "opaque": "secret", "assign": "secret", "hex": "secret", "endpoint": "endpoint"}
RANK = {k: i for i, k in enumerate([*BASE, *WEAK])}
#: Rank of an empty line among parts; parts into which the copies of one text are dealt; characters of a block of text.
BREAK, SALT, BLOCK = -1, 16, 1024


def running(values: Column, step) -> Column:
    """Running totals by ``step`` (sum, greatest, ...), in rounds that double the reach, so long arrays take n log n steps."""
    reach = F.array(*[F.lit(1 << k) for k in range(30)])
    join = lambda x, p: F.transform(x, lambda v, i: F.when(i >= p, step(v, F.get(x, i - p))).otherwise(v))
    return F.aggregate(reach, values, lambda x, p: F.when(F.size(x) > p, join(x, p)).otherwise(x))


def spans(text: Column, pattern: str, least: int, group: int = 0, holds: str | None = None) -> Column:
    """Array of structs (start, end), in code points, of the leftmost non-overlapping matches.

    The text between matches and the matches themselves alternate, so running
    sums of their lengths are the positions. ``least`` drops matches whose
    group ``group`` is shorter, after matching, and ``holds`` those in which
    that pattern doesn't occur.
    """
    every = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("tested"))

    def places(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: F.length(g) + F.length(m)), lambda v, w: v + w)
        good = lambda m, t: (F.length(t) >= least) & (m.rlike(holds) if holds else F.lit(True))
        rows = F.zip_with(F.arrays_zip(x["found"].alias("m"), x["tested"].alias("t")), ends, lambda y, e: F.struct((e - F.length(y["m"])).alias("start"), e.alias("end"), good(y["m"], y["t"]).alias("good")))
        return F.transform(F.filter(rows, lambda y: y["good"]), lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end")))

    return F.when(text.rlike(pattern), bind(every, places)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def breaks_of(text: Column) -> Column:
    """The empty lines of a text as (start, rank, end)."""
    return F.transform(spans(text, "\\n\\n+", 1), lambda x: F.struct(x["start"].alias("start"), F.lit(BREAK).alias("rank"), x["end"].alias("end")))


def _tagged(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(RANK[kind]).alias("rank"), x["end"].alias("end")))


def joined(parts: Column) -> Column:
    """``kind:start:end`` of a sorted array of (start, rank, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in RANK])
    return F.array_join(F.transform(parts, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", reach: int = 200, broadcast_rows: int = 50_000) -> DataFrame:
    """Adds ``base`` and ``found``, sorted arrays of (start, rank, end), to every row.

    ``base`` holds the strong findings, ``found`` also the weak parts that
    linking confirms. A scope is a paragraph, that is text between empty
    lines. A weak part is confirmed if its scope holds a part of another role
    that ends at most ``reach`` characters before its start or starts at most
    ``reach`` characters after its end. Parts that overlap don't confirm each
    other, and an opaque run inside an endpoint or identifier is no part.

    Texts are scanned once. Only the parts of texts with a weak candidate
    enter the interval join, once per distinct text, and the join looks at
    windows of positions, never at pairs, so neither many copies nor a text
    with many parts multiplies rows.

    The findings meet the rows by a broadcast of up to ``broadcast_rows``
    counted texts, beyond that by a shuffle in which copies of a text are dealt
    to several keys.

    Null text counts as empty. Repeated rows are all kept. An empty table
    gives an empty result. Columns named ``base``, ``found`` or ``text_key``
    are replaced; all others stay, the text included.
    """
    kept = [c for c in docs.columns if c not in ("base", "found", "text_key")]
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[_tagged(k, spans(body, p, n, 2 if k == "assign" else 0)) for k, (p, n) in BASE.items()]))
    # An opaque run counts only if it holds a digit.
    weak = F.concat(*[_tagged(k, spans(body, p, n, holds="[0-9]" if k == "opaque" else None)) for k, (p, n) in WEAK.items()])
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    parts = docs.select(F.md5(body).alias("text_key"), body.alias("body"), base.alias("base"), weak.alias("weak")).where((F.size("base") > 0) | (F.size("weak") > 0))
    parts = cut(
        parts.select("text_key", "base", "weak", F.when(F.size("weak") > 0, breaks_of(F.col("body"))).otherwise(none).alias("breaks"))
        .groupBy("text_key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"), F.first("breaks").alias("breaks")),
        "secrets",
    )

    roles = F.array(*[F.lit(ROLE[k]) for k in RANK])
    rows = parts.where(F.size("weak") > 0).select("text_key", F.explode(F.concat("base", "weak", "breaks")).alias("p")).select("text_key", "p.start", "p.rank", "p.end")
    # The breaks before a part number its scope.
    before = W.partitionBy("text_key").orderBy("start").rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("scope", F.coalesce(F.sum((F.col("rank") == BREAK).cast("int")).over(before), F.lit(0))).where(F.col("rank") != BREAK).withColumn("role", F.get(roles, F.col("rank")))
    # An opaque run lies inside a part that starts no later and ends no earlier.
    upto = W.partitionBy("text_key", "scope").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    around = F.max(F.when(F.col("rank").isin(RANK["identifier"], RANK["endpoint"]), F.col("end"))).over(upto)
    rows = rows.withColumn("inside", (F.col("rank") == RANK["opaque"]) & (around >= F.col("end"))).where(~F.coalesce("inside", F.lit(False)))
    # Each part's start looks back for ends, its end looks ahead for starts.
    sides = rows.select("*", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(False).alias("is_end")), F.struct(F.col("end").alias("at"), F.lit(True).alias("is_end")))).alias("s"))
    sides = sides.select("text_key", "scope", "start", "rank", "end", "role", "s.at", "s.is_end")
    order = W.partitionBy("text_key", "scope").orderBy("at")
    seen = lambda role, is_end, lo, hi: F.max((F.col("role") == role) & (F.col("is_end") == is_end)).over(order.rangeBetween(lo, hi))
    beside = F.lit(False)
    for role in sorted(set(ROLE.values())):
        beside = beside | (F.col("role") != role) & F.when(F.col("is_end"), seen(role, False, 0, reach)).otherwise(seen(role, True, -reach, 0))
    linked = (
        sides.withColumn("beside", beside)
        .where((F.col("rank") >= len(BASE)) & F.col("beside"))
        .groupBy("text_key").agg(F.collect_set(F.struct("start", "rank", "end")).alias("linked"))
    )
    found = parts.join(linked, "text_key", "left").select("text_key", "base", F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked"))).alias("found"))
    own, salt, b, f, mine, part = (apart(x, docs.columns) for x in ("found_key", "found_salt", "found_base", "found_all", "own_key", "own_salt"))
    found = found.select(F.col("text_key").alias(own), F.col("base").alias(b), F.col("found").alias(f))
    out, same = docs.select(*kept, F.md5(body).alias(mine)), F.col(mine) == F.col(own)
    if parts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        out = out.join(F.broadcast(found), same, "left")
    else:  # copies of a text are dealt to SALT keys, each of which meets its findings
        dealt = F.pmod(F.xxhash64(*[c for c in kept if c != text] or [text]), F.lit(SALT)).cast("int")
        found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = out.withColumn(part, dealt).join(found.hint("merge"), same & (F.col(part) == F.col(salt)), "left")
    return out.select(*kept, F.coalesce(F.col(b), none).alias("base"), F.coalesce(F.col(f), none).alias("found"))


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """``text`` with every found span replaced by ``mark``; overlapping spans become one mark.

    Spans must be sorted by start. What stays is read from blocks of the text, so its length counts once.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def out(x: Column) -> Column:
        def piece(s: Column, e: Column) -> Column:
            first, last = (s / BLOCK).cast("int"), ((e - 1) / BLOCK).cast("int")
            return F.when(e > s, F.substring(F.array_join(F.slice(x["blocks"], first + 1, last - first + 1), ""), s % BLOCK + 1, e - s)).otherwise("")

        ends = x["ends"]
        done = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        kept = F.transform(x["found"], lambda y, i: F.when(y["start"] >= done(i), F.concat(piece(done(i), y["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), piece(F.element_at(ends, -1), x["size"]))

    ends = running(F.transform(found, lambda y: y["end"]), F.greatest)
    whole = F.struct(blocks.alias("blocks"), found.alias("found"), ends.alias("ends"), F.length(text).alias("size"))
    return F.when(F.size(found) > 0, bind(whole, out)).otherwise(text)
