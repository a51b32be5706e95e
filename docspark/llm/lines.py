"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, components, discard, small, written

#: A line of fewer characters than this many a tolerated edit is compared for equality only.
CHARS_AN_EDIT = 10
#: Characters counted, beside all others together, before a distance is worked out; any of one byte would do.
KINDS = " etanoirshdlucmfpgwybvkxjqz.,"


def edit_distance_within(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two texts, or ``k + 1`` when it is larger.

    A band of ``2 k + 1`` diagonals, one bit each, for every number of errors from 0 to ``k``: after
    a character of ``b`` a diagonal is alive with e errors if it was and the characters agree, or
    if it or a neighbour was alive with e - 1 (other character, one more in ``b``, one more in ``a``).
    """
    width = (1 << 2 * k + 1) - 1

    def masks(pa: Column, pb: Column, n: Column) -> Column:
        def mask(j: Column) -> Column:
            c = F.get(pb, j - 1)
            bits = [F.when(F.get(pa, j + (d - 1)) == c, F.lit(1 << d + k)).otherwise(F.lit(0)) for d in range(-k, k + 1)]
            return reduce(lambda x, y: x + y, bits)

        return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), mask)

    def step(acc: Column, m: Column) -> Column:
        rows = [acc["r0"].bitwiseAND(m)]
        for e in range(1, k + 1):
            old = acc[f"r{e - 1}"]
            alive = acc[f"r{e}"].bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
            rows.append(alive.bitwiseAND(F.lit(width)))
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(rows)])

    start = F.struct(*[F.lit(((1 << e + 1) - 1) << k).alias(f"r{e}") for e in range(k + 1)])

    def judged(p: Column) -> Column:
        na, nb = F.length(a), F.length(b)

        def finish(acc: Column) -> Column:
            out = F.lit(k + 1)
            for e in range(k, -1, -1):
                out = F.when(F.getbit(acc[f"r{e}"], na - nb + k) == 1, F.lit(e)).otherwise(out)
            return out

        return F.when(F.abs(na - nb) > k, F.lit(k + 1)).otherwise(F.aggregate(masks(p["a"], p["b"], nb), start, step, finish))

    # both texts are cut into characters once
    return F.get(F.transform(F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))), judged), F.lit(0))


def _parts(edits: int) -> list[tuple[bool, int]]:
    """Parts of a stretch, one of which two stretches within ``edits`` have in common: seen from its start (or end), and which one.

    Of ``edits + 1`` equal parts, one is untouched with exactly its number of edits before it,
    counted from 0, and the rest behind it at most; so seen from the nearer end it is moved by no
    more places than parts lie between. Cut shorter by as many, it stands in its own place in one of
    the two stretches, and 0 or more places farther from that end in the other.
    """
    return [(j <= edits - j, min(j, edits - j)) for j in range(edits + 1)]


def _short_buckets(k: int, chars_an_edit: int) -> list[int]:
    """For lengths below ``k * chars_an_edit`` the smallest length of their bucket: one bucket's lines have the same most tolerant partner."""
    starts = {0} | {s for j in range(1, k + 1) for s in (j * chars_an_edit - k, j * chars_an_edit) if s > 0}
    return [max(s for s in starts if s <= n) for n in range(k * chars_an_edit)]


def _bucket(n: Column, short: list[int]) -> Column:
    """Smallest length of the bucket that a length is in: longer lengths with equal first three bits share one."""
    width = F.pow(F.lit(2), F.floor(F.log2(n)) - 2)
    known = F.array(*[F.lit(s) for s in short])
    return F.when(n < len(short), F.get(known, n)).otherwise(F.greatest(F.lit(len(short)), F.floor(n / width) * width).cast("int"))


def _piece(at: Column, size: Column) -> Column:
    """Bytes of so many characters of ``line``; in a line of ASCII a character is a byte, found without reading what stands before it."""
    line = F.col("line")
    return F.when(F.octet_length(line) == F.col("n"), F.substring(line.cast("binary"), at, size)).otherwise(F.substring(line, at, size).cast("binary"))


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def _first_keys(lines: DataFrame, k: int, chars_an_edit: int) -> DataFrame:
    """``lines`` once a key: ``low`` (of the bucket), ``edits``, ``part``, ``at`` (from 1), ``size`` and ``key``.

    A line stands in the bucket of its own length and of each that a line up to ``k`` shorter is in,
    so two lines that link meet in the bucket of the shorter one. It is cut for ``edits``, the most
    that any line in reach of the bucket tolerates.
    """
    n, short = F.col("n"), _short_buckets(k, chars_an_edit)
    first, last = _bucket(n, short), _bucket(F.greatest(n - k, F.lit(0)), short)
    lows = F.when(first == last, F.array(first)).otherwise(F.array_distinct(F.array(*[_bucket(F.greatest(n - j, F.lit(0)), short) for j in range(k + 1)])))
    most = F.array(*[F.lit(max([j for j in range(1, k + 1) if low >= j * chars_an_edit - k], default=0)) for low in short])
    cuts = F.array(*[
        F.array(*[
            F.struct(F.lit(j).alias("part"), F.lit(front).alias("front"), F.lit(off).alias("off"), F.lit(moved).alias("moved"))
            for j, (front, off) in enumerate(_parts(e)) for moved in range(off + 1)
        ]) for e in range(k + 1)
    ])
    placed = lines.select("*", F.explode(lows).alias("low"))
    placed = placed.withColumn("edits", F.when(F.col("low") < len(short), F.get(most, F.col("low"))).otherwise(k)).where("edits > 0")
    cut = placed.select("*", F.explode(F.get(cuts, F.col("edits"))).alias("c"), _div(F.col("low"), F.col("edits") + 1).alias("base"))
    cut = cut.withColumn("size", F.greatest(F.col("base") - F.col("c.off"), F.lit(0)))
    away = F.col("c.off") * F.col("base") + F.col("c.moved")
    cut = cut.withColumn("at", F.when(F.col("c.front"), away).otherwise(n - away - F.col("size")) + 1)
    return cut.select(*lines.columns, "low", "edits", "c.part", "at", "size", F.xxhash64("low", "c.part", _piece(F.col("at"), F.col("size"))).alias("key"))


def _second_keys(met: DataFrame, k: int) -> DataFrame:
    """Rows of :func:`_first_keys` once a longer key: what stands before and behind the common part is cut again.

    Before part ``j`` are ``j`` edits at most and behind it the rest, so each side has a part of its
    own in common, seen from the common part or from the line's end. ``key`` is replaced.
    """
    n, at, size, low, edits, part = (F.col(c) for c in ("n", "at", "size", "low", "edits", "part"))

    def sides(e: int, j: int) -> list[Column]:
        ways = lambda x: [(p, near, off, moved) for p, (near, off) in enumerate(_parts(x)) for moved in range(off + 1)]
        return [
            F.struct(*[F.lit(v).alias(name) for name, v in zip(("no", "ln", "lo", "lm", "rn", "ro", "rm"), (p * (k + 1) + q, *a, *b), strict=True)])
            for p, *a in ways(j) for q, *b in ways(e - j)
        ]

    none = F.array().cast("array<struct<no:int,ln:boolean,lo:int,lm:int,rn:boolean,ro:int,rm:int>>")
    cuts = F.array(*[F.array(*sides(e, j)) if j <= e else none for e in range(1, k + 1) for j in range(k + 1)])
    base, front = _div(low, edits + 1), 2 * part <= edits
    before = F.when(front, base * part).otherwise(low - base * (edits + 1 - part))
    behind = F.when(front, low - base * (part + 1)).otherwise(base * (edits - part))
    cut = met.select("*", F.explode(F.get(cuts, (edits - 1) * (k + 1) + part)).alias("c"), _div(before, part + 1).alias("lb"), _div(behind, edits - part + 1).alias("rb"))
    cut = cut.withColumn("ls", F.greatest(F.col("lb") - F.col("c.lo"), F.lit(0))).withColumn("rs", F.greatest(F.col("rb") - F.col("c.ro"), F.lit(0)))
    left, right = F.col("c.lo") * F.col("lb") + F.col("c.lm"), F.col("c.ro") * F.col("rb") + F.col("c.rm")
    la = F.when(F.col("c.ln"), at - left - F.col("ls")).otherwise(left + 1)
    ra = F.when(F.col("c.rn"), at + size + right).otherwise(n - right - F.col("rs") + 1)
    return cut.withColumn("key", F.xxhash64("key", "c.no", _piece(la, F.col("ls")), _piece(ra, F.col("rs"))))


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, chars_an_edit: int = CHARS_AN_EDIT,
) -> tuple[DataFrame, DataFrame]:
    """``(lines, occurrences)``: distinct lines that repeat, exactly or nearly, with their class; and where they stand.

    Two lines link when their edit distance is at most ``k`` and ``chars_an_edit`` times it is at
    most the longer line's length. Lines of one class are joined by links. ``lines`` has ``line,
    class_id`` (two hashes of one line of the class), ``occurrences`` has ``_id, _text, no, class_id``
    (line number from 0). Blank lines belong to no class. Lines are told apart by two independent
    64-bit hashes. Texts are read again for the few lines that share a part with another line;
    lines that share a longer part, too, are tested, each first with the one it shares most
    with, then with those of other classes.
    """
    check_columns(docs, id_col, text_col)
    if k < 1 or chars_an_edit < 1:
        raise ValueError("k and chars_an_edit must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.split(text, "\n").alias("_l"))
    stand = rows.select("_id", "_text", F.posexplode("_l").alias("no", "line")).where("trim(line) <> ''").select(
        "_id", "_text", "no", "line", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    places = written(stand.select("_id", "_text", "no", "h1", "h2"))
    hashed = stand.select("h1", "h2", "line", "n")
    keyed = _first_keys(hashed, k, chars_an_edit).select("key", "h1", "h2")
    lists = written(keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key"))
    met = written(keyed.join(small(lists), "key", "left_semi").select("h1", "h2").distinct())
    texts = hashed.join(small(met), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    counts = F.array(*[F.octet_length("line") - F.octet_length(F.replace("line", F.lit(x))) for x in KINDS])
    texts = texts.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "line", "n", counts.alias("kinds"))
    texts = written(texts.withColumn("others", F.col("n") - F.aggregate("kinds", F.lit(0), lambda x, y: x + y)))
    first_keys = _first_keys(texts.select("id", "n", "line"), k, chars_an_edit)
    entries = written(_second_keys(first_keys.join(small(lists), "key", "left_semi"), k).select("key", "id"))
    deep = written(entries.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("hi")).where("head <> hi").select("key", "head"))
    shared = written(entries.join(small(deep), "key").distinct())
    discard(lists, met, entries, deep)

    def side(df: DataFrame, x: str, *more: str) -> DataFrame:
        return df.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("kinds").alias(f"k{x}"), F.col("others").alias(f"o{x}"), *more)

    def alike() -> Column:
        """An edit raises one number of characters at most and lowers one at most."""
        each = [F.greatest(F.get("ka", F.lit(i)) - F.get("kb", F.lit(i)), F.lit(0)) for i in range(len(KINDS))]
        longer, others = F.col("na") - F.col("nb"), F.col("oa") - F.col("ob")
        more = reduce(lambda x, y: x + y, [*each, F.greatest(others, F.lit(0))])
        # all characters are counted, so what is lowered is what is raised without the difference in length
        return (F.abs(longer) <= k) & (more <= k) & (more - longer <= k)

    def tested(pairs: DataFrame) -> DataFrame:
        """Of pairs ``a, b`` those that link; the distance is worked out for all that are alike."""
        pairs = written(pairs.distinct())
        both = side(texts, "a", F.col("line").alias("la")).join(small(pairs), "a").join(side(texts, "b", F.col("line").alias("lb")), "b").where(alike())
        # few rows of much work each: dealt out, else their few bytes bring them to one task
        both = both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        near = both.select("a", "b", F.greatest("na", "nb").alias("longer"), edit_distance_within(F.col("la"), F.col("lb"), k).alias("d"))
        found = written(near.where((F.col("d") <= k) & (chars_an_edit * F.col("d") <= F.col("longer"))).select("a", "b"))
        discard(pairs)
        return found

    most = shared.where("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("c"))
    first = tested(most.groupBy("id").agg(F.max(F.struct("c", -F.col("head"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.col2")).alias("b")))
    roots = written(components(first))
    placed = written(shared.drop("head").join(small(roots), "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp")))
    still_open = written(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"))
    crossing = written(placed.join(small(still_open), "key", "left_semi").join(texts.select("id", "n", "kinds", "others"), "id"))
    x, y = side(crossing, "a", "key", F.col("comp").alias("ca")), side(crossing, "b", "key", F.col("comp").alias("cb"))
    second = tested(x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike()).select("a", "b"))
    final = written(components(first.unionByName(second)))
    names = texts.select("id", "h1", "h2")
    linked = final.join(names, "id").join(names.select(F.col("id").alias("root"), F.struct("h1", "h2").alias("class_id")), "root").select("h1", "h2", "class_id")
    linked = written(linked)
    copies = places.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2", F.struct("h1", "h2").alias("class_id"))
    classes = written(linked.unionByName(copies.join(small(linked), ["h1", "h2"], "left_anti")))
    discard(texts, shared, roots, placed, still_open, crossing, first, second, final, linked)
    lines = hashed.join(small(classes), ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("line", "class_id")
    return lines, places.join(small(classes), ["h1", "h2"]).select("_id", "_text", "no", "class_id")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """Per document: id, ``n_lines``, ``n_dropped``, ``dropped`` (numbers of lines to drop, from 0) and ``text_hash``.

    Of every class of lines the first occurrence stays, in order of id and line number; all later
    ones are dropped. Blank lines always stay. NULL and empty texts have one blank line; ids that
    are NULL come last; repeated rows of one id and text get equal results and keep their lines;
    other columns are ignored.
    """
    _, occurrences = line_classes(docs, id_col, text_col, k, chars_an_edit)
    occurrences = written(occurrences)
    # NULL ids last: false sorts before true
    place = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_text"), F.col("no"))
    firsts = written(occurrences.groupBy("class_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = occurrences.join(small(firsts), "class_id").where(place != F.col("first"))
    per_doc = later.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("no")).alias("dropped")).select(F.col("_id").alias("_fid"), F.col("_text").alias("_ft"), "dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    return rows.join(per_doc, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text") == F.col("_ft")), "left").select(
        F.col("_id").alias(id_col), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), F.col("_text").alias("text_hash"),
    )


def drop_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``found`` (of :func:`repeated_lines`) drops."""
    hit = found.where("n_dropped > 0").select(F.col(id_col).alias("_fid"), F.col("text_hash").alias("_ft"), F.col("dropped").alias("_dropped")).distinct()
    text = F.coalesce(F.col(f"_d.`{text_col}`"), F.lit(""))
    joined = docs.alias("_d").join(hit, F.col(f"_d.`{id_col}`").eqNullSafe(F.col("_fid")) & (F.xxhash64(text) == F.col("_ft")), "left")
    left = lambda t: F.transform(F.array_except(F.sequence(F.lit(0), F.size(t) - 1), "_dropped"), lambda i: F.get(t, i))
    kept = F.array_join(F.flatten(F.transform(F.array(F.split(text, "\n")), left)), "\n")
    return joined.select(*[
        F.when(F.col("_dropped").isNotNull(), kept).otherwise(F.col(f"_d.`{c}`")).alias(c) if c == text_col else F.col(f"_d.`{c}`") for c in docs.columns
    ])
