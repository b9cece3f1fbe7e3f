"""Line deduplication by a segment-partition edit join, with DataFrame expressions alone.

Lines of at least ``MIN_CHARS`` characters are duplicates when ``EDITS`` edits or fewer turn one into the other.  A line of a given length
is cut into ``EDITS + 1`` segments; two such lines share one of them, at places that differ little.  Each line is indexed by
its segments and probes the segments of lines as long or a little shorter by those of its substrings that can match (lengths,
segment numbers and shifts are bounded).  Both meet by the hash of segment, number and length.

1. Keys are counted first: only lines whose key another line has go on, with their texts.
2. These get two signatures, counts of letters in Gray code and parities of words, which an edit changes in few bits.  Signatures of two
   lines that link agree in one of ``2 * EDITS + 1`` chunks, so a key is split by chunks: what only shares a segment is parted.
3. In ``ROUNDS`` rounds every line of such a cell is compared with the cell's pivot, and the components of what links are
   contracted.  Then index and probe meet within cells, for lines of different components only.
4. Pairs whose signatures allow it are verified, without common beginnings and ends, by a bit-parallel edit distance in a band of
   ``2 * EDITS + 1`` diagonals.

Of each group of lines that links connect, the first by document and place stays and the others go.

Equal lines count as one, by 128 bits of hash, before the join.  With ``short`` that holds for shorter lines too: of equal ones, if they aren't
blank, the first stays; they have no part in the edit join.  Without it they always stay.  Blank ones do either way, and null texts stay null.
Rows with one id and one text are one document; a null id comes first in order.  Extra columns pass through, whatever their names.  Very long
texts and lines are taken whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, compact
from .components import connected_components

MIN_CHARS = 16
EDITS = 2
#: Times that the lines of a cell are compared with a pivot, each time another one.
ROUNDS = 2
#: Tables of counted rows up to here are broadcast (16 MB of ids).
BROADCAST_ROWS = 1_000_000


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """``key`` (of the document), ``place``, ``line`` for lines long enough; with ``short`` for shorter ones too that aren't blank."""
    rows = docs.where(F.col("text").isNotNull()).select(*document_key(), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    enough = F.length("line") >= min_chars
    return rows.where(enough | F.col("line").rlike(r"\S") if short else enough)


def document_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("of_text")]


#: Characters whose counts a line's signature has.
LETTERS = "abcdefghijklmnopqrstuvwxyz.,ETAO"


def letters_of(line: Column) -> Column:
    """Two bits for each of LETTERS: its count, modulo 4, in Gray code.  An edit changes two counts by one at most, and so two bits."""
    out = F.lit(0).cast("bigint")
    for k, letter in enumerate(LETTERS):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(F.lit(3))
        out = out.bitwiseXOR(F.shiftleft(count.bitwiseXOR(F.shiftright(count, 1)).cast("bigint"), 2 * k))
    return out


def words_of(line: Column) -> Column:
    """A bit for each word, by hash, that cancels out in pairs; an edit takes away or adds three words at most, as it may join or part two."""
    bits = F.transform(F.split(line, " "), lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def alike(edits: int) -> Column:
    """Whether the signatures (letters, words) and (by_letters, by_words) allow so few edits."""
    apart = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"by_{c}")))
    return (apart("letters") <= 2 * edits) & (apart("words") <= 3 * edits)


def chunks_of(letters: Column, edits: int) -> Column:
    """The signature in ``2 * edits + 1`` numbered parts: it differs in ``2 * edits`` bits at most, so one of them is equal."""
    k = 2 * edits + 1
    cuts = [64 * i // k for i in range(k + 1)]
    return F.array(*[F.xxhash64(F.lit(i), F.shiftrightunsigned(F.shiftleft(letters, 64 - hi), 64 - hi + lo)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def segment(n: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start, from 1, and length of segment ``i`` of a line of ``n`` characters in ``k`` even segments; later ones are longer."""
    base, longer = F.floor(n / k).cast("int"), (n % k).cast("int")
    return i * base + F.greatest(F.lit(0), i - k + longer) + 1, base + F.when(F.lit(k) - i <= longer, 1).otherwise(0)


def line_keys(line: Column, n: Column, edits: int) -> Column:
    """Hashes of the line's segments, ``edits + 1`` of them, and then of other substrings that can match a segment of a line up to ``edits`` shorter."""
    k, own, other = edits + 1, [], []
    for less in range(edits + 1):
        for i in range(k):
            start, m = segment(n - less, i, k)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                (other if less or shift else own).append(F.xxhash64(F.substring(line, start + shift, m), F.lit(i), n - less))
    return F.array(*own, *other)


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two lines, or more than ``edits`` if that is so.

    A word holds the vertical differences of a column of the distance table within a band: bit ``d`` is row ``column - edits + d`` of the
    longer line.  Each character of the shorter line moves the band on by a fixed number of bit operations.  The distance is
    followed along the diagonal that ends in the corner.  Rows above the first are worth their distance from it.
    """
    width = 2 * edits + 1
    lit = lambda x: F.lit(x).cast("bigint")
    full = (1 << width) - 1

    def of(s: Column) -> Column:
        p, t = s["p"], s["t"]
        more = F.size(p) - F.size(t)

        def step(state: Column, j: Column) -> Column:
            def matches(c: Column) -> Column:
                out = lit(0)
                for d in range(width):
                    row = j + (d - edits)
                    out = out + F.when((row >= 1) & (row <= F.size(p)) & F.coalesce(F.get(p, row - 1) == c, F.lit(False)), lit(1 << d)).otherwise(lit(0))
                return out

            def move(eq: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                diagonal = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(lit(full))

                def turn(d0: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(lit(full))
                    over = F.shiftrightunsigned(d0, 1)
                    stays = F.get(F.array(*[F.shiftrightunsigned(d0, edits + k).bitwiseAND(lit(1)) for k in range(edits + 1)]), more)
                    return F.struct(
                        d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(over.bitwiseOR(hp))).bitwiseAND(lit(full)).alias("vp"),
                        over.bitwiseAND(hp).alias("vn"),
                        (state["score"] + lit(1) - stays).alias("score"),
                    )

                return bind(diagonal, turn)

            return bind(bind(F.element_at(t, j), matches), move)

        start = F.struct(lit(full ^ ((1 << edits) - 1)).alias("vp"), lit((1 << edits) - 1).alias("vn"), more.cast("bigint").alias("score"))
        walked = F.aggregate(F.sequence(F.lit(1), F.size(t)), start, step, lambda x: x["score"])
        return F.when(more > edits, more.cast("bigint")).when(F.size(t) == 0, more.cast("bigint")).otherwise(walked)

    def core(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        longer = F.length(x) >= F.length(y)
        chars = lambda v: F.when(F.length(v) == 0, F.array().cast("array<string>")).otherwise(F.split(v, ""))
        return bind(F.struct(chars(F.when(longer, x).otherwise(y)).alias("p"), chars(F.when(longer, y).otherwise(x)).alias("t")), of)

    return bind(bind(F.struct(a.alias("a"), b.alias("b")), lambda s: trimmed(s, False)), lambda s: bind(trimmed(s, True), core))


def trimmed(pair: Column, tails: bool) -> Column:
    """Two strings without the beginning, or end, that they share, which binary search over its length finds."""

    def of(n: Column) -> Column:
        keep = lambda v: F.substring(v, F.lit(1) if tails else n + 1, F.length(v) - n)
        return F.struct(keep(pair["a"]).alias("a"), keep(pair["b"]).alias("b"))

    shorter = F.least(F.length(pair["a"]), F.length(pair["b"]))
    part = (lambda v, n: F.right(v, n)) if tails else (lambda v, n: F.substring(v, F.lit(1), n))
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    longest = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= shorter) & (part(pair["a"], n + s) == part(pair["b"], n + s)), n + s).otherwise(n))
    return bind(longest, of)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, of a few numbers each, are at most BROADCAST_ROWS; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs of nodes (a, b) that few enough edits part."""
    left, right = texts.select(F.col("node").alias("a"), F.col("line").alias("x")), texts.select(F.col("node").alias("b"), F.col("line").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(banded_distance(F.col("x"), F.col("y"), edits) <= edits).select("a", "b")


def more_than_one(rows: DataFrame, key: str, what: str) -> DataFrame:
    """The rows of keys that hold several values."""
    return rows.join(rows.groupBy(key).agg(F.min(what).alias("__lo"), F.max(what).alias("__hi")).where("__lo <> __hi").select(key), key)


def meeting(keys: DataFrame, live: DataFrame, edits: int) -> DataFrame:
    """``key, id, indexed``: each line once for each of its keys that others have too.

    Few such keys go to all tasks, and what is left is combined there.  Else repeats of a line are combined before keys meet by a shuffle: they add nothing, and would
    bring a boilerplate line's every occurrence to one task.
    """
    once = [F.col("key"), F.col("id")]
    indexed = (F.min("at") <= edits).alias("indexed")
    if live.count() <= BROADCAST_ROWS:
        return keys.join(F.broadcast(live), "key").groupBy(*once).agg(indexed)
    return keys.groupBy(*once).agg(indexed).join(live, "key")


def edit_components(hashed: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """``id, id2, component`` of the lines that link, of ``hashed`` (id, id2, keys) with texts in ``lines`` (id, id2, line)."""
    keys = hashed.where("keys is not null").select("id", F.posexplode("keys").alias("at", "key"))
    live = checkpoint(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"))
    met = compact(meeting(keys, live, edits))
    wanted = compact(met.select("id").distinct())
    texts = lines.join(small(wanted), "id", "left_semi").groupBy("id", "id2").agg(F.first("line").alias("line"))
    texts = checkpoint(texts.select("id", "id2", "line", F.monotonically_increasing_id().alias("node"), letters_of(F.col("line")).alias("letters"), words_of(F.col("line")).alias("words")))
    signed = texts.select("id", "node", "letters", "words", F.explode(chunks_of(F.col("letters"), edits)).alias("chunk"))
    cells = met.join(signed, "id").select(F.xxhash64("key", "chunk").alias("cell"), "node", "indexed", "letters", "words")
    cells = compact(more_than_one(cells, "cell", "node").withColumn("c", F.col("node")))
    pair = [F.least("node", "by").alias("a"), F.greatest("node", "by").alias("b")]
    links = None
    for turn in range(ROUNDS):
        least = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("by"), F.col("letters").alias("by_letters"), F.col("words").alias("by_words")))
        pivots = cells.groupBy("cell").agg(least.alias("p")).select("cell", "p.by", "p.by_letters", "p.by_words")
        found = compact(verified(cells.join(pivots, "cell").where(F.col("node") != F.col("by")).where(alike(edits)).select(*pair).distinct(), texts, edits))
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links).withColumnRenamed("id", "node")
        cells = cells.drop("c").join(comps.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        cells = compact(more_than_one(cells, "cell", "c"))
    probes = cells.select("cell", F.col("node").alias("by"), F.col("c").alias("by_c"), F.col("letters").alias("by_letters"), F.col("words").alias("by_words"))
    rest = cells.where("indexed").join(probes, "cell").where(F.col("c") != F.col("by_c")).where(alike(edits)).select(*pair).distinct()
    found = compact(verified(rest, texts, edits))
    comps = connected_components(found if links is None else links.unionByName(found))
    return comps.withColumnRenamed("id", "node").join(texts.select("node", "id", "id2"), "node").select("id", "id2", "component")


def duplicate_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """``doc, of_text, place, near`` of each line that goes; ``near``: not equal to one that comes before it."""
    line, n = F.col("line"), F.col("n")
    ids = [F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit("second")).alias("id2")]
    hashed = lines_of(docs, min_chars, short).withColumn("n", F.length("line")).select("doc", "of_text", "place", *ids, F.when(n >= min_chars, line_keys(line, n, edits)).alias("keys"))
    hashed = checkpoint(hashed)
    comps = edit_components(hashed, lines_of(docs, min_chars).select(*ids, "line"), edits)
    order = F.struct("doc", "place", "of_text")
    equal = hashed.groupBy("id", "id2").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    linked = compact(equal.join(comps, ["id", "id2"]))
    kept = linked.groupBy("component").agg(F.min("first").alias("keep"))
    kept = linked.join(kept, "component").select("id", "id2", "keep")
    per_line = equal.join(kept, ["id", "id2"], "left").select("id", "id2", "first", F.coalesce("keep", "first").alias("keep"), "n").where("n > 1 or first <> keep")
    per_line = checkpoint(per_line)  # so that the join below deals both sides out and can split a common line's rows
    out = hashed.select("doc", "of_text", "place", "id", "id2").join(per_line, ["id", "id2"]).where(order != F.col("keep"))
    return out.select("doc", "of_text", "place", (F.col("first") == order).alias("near"))


def with_kept_text(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False, named: tuple[str, str, str, str] = ("kept", "n_lines", "n_gone", "n_near")) -> DataFrame:
    """The documents with ``kept`` (the text without the lines that go), ``n_lines``, ``n_gone`` and ``n_near``, or as ``named``; these take the place of columns with such names."""
    gone = duplicate_lines(docs, edits, min_chars, short).groupBy("doc", "of_text").agg(F.collect_set("place").alias("places"), F.count_if("near").alias("n_near"))
    doc, of_text = document_key()
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], doc.alias("__doc"), of_text.alias("__of_text"))
    gone = gone.select(F.col("doc").alias("__doc"), F.col("of_text").alias("__of_text"), F.col("places").alias("__places"), F.col("n_near").alias("__near"))
    rows = keyed.join(gone, ["__doc", "__of_text"], "left")
    lines = F.split("text", "\n")
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__places"))
    kept = bind(lines, lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))
    kept = F.when(F.col("__places").isNull(), F.col("text")).otherwise(kept)
    found = [kept, F.size(lines), F.coalesce(F.size("__places"), F.lit(0)), F.coalesce("__near", F.lit(0))]
    return rows.select(*[F.col(f"`{c}`") for c in names if c.lower() not in named], *[x.alias(c) for x, c in zip(found, named)])


def deduplicate(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """The documents, their texts without the lines that go; ``n_chars`` follows where there is one."""
    rows = with_kept_text(docs, edits, min_chars, short, ("__kept", "__lines", "__gone", "__near"))
    columns = [F.col("__kept").alias(c) if c == "text" else F.length("__kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns)
