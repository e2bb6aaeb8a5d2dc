"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Texts are cut at white space, and punctuation is left out; words of punctuation only vanish. A word is its small letters and digits, or a typed
placeholder:

* a *number* is a word with a digit in it;
* a *name* is any other word that begins with a capital inside a sentence (the word before it doesn't end in ``. ! ? :``);
* a *unit* is a word of ``UNITS`` right after a number;
* a word with a capital that begins a sentence may be a name or not. Windows that hold such words are joined in two forms: with all of them as
  plain words and with all of them as names.

Windows of ``WIDTH`` words in this form, of benchmark items and of documents, are joined by hash. A window with fewer than ``LITERAL`` plain words
is too general: there the words behind the placeholders have to agree. An item consists of its windows of the first kind, or of all its windows
if it has none; an item of fewer words is one window of its own width. It is found in a document where ``share`` of its distinct windows
occur close together, and where the placeholders are consistent: over all aligned slots, ``share`` of them take the value that their type and
value in the item take most often in the document. Where an item's windows repeat, a place in the document is aligned with one place of
the item, by the shift on which most windows agree. So the copy of a question is found with other names and numbers put in, while a text
that merely has the same pattern with values mixed at random isn't.

Each window of an item is looked for in two more forms: in small letters, and word for word, as it shows in a text of capitals. So copies in other
case are found as well, and, by the form with names, copies whose first word follows upon other words.

The windows of the benchmark are a table of their own; Spark broadcasts it where its size is below the session's threshold, and
shuffles otherwise. Windows of documents never leave their task unless they match.

Defined cases: null and empty texts, and texts of punctuation alone, have no windows; every other item has one. An item of one to four words is found wherever they
stand in a row. Rows of one ``doc_id`` count as one document, a null ``doc_id`` as an id like others. Of repeated items with one ``item_id``
the least text counts, null ids don't. Empty tables give an empty result; columns other than the id and ``text`` are not read.
Two different windows are taken as equal if two 64-bit hashes coincide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ribeira.llm.common import read
from ribeira.session import materialize

WIDTH = 5
LITERAL = 2
SHARE = 0.8
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
FIRST = "\u0004"
"""Marks a word with a capital at the beginning of a sentence."""
AFTER = "\u0005"
# Units of measure and money
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs day days week weeks month months year years "
    "meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre "
    "litres gallon gallons second seconds minute minutes hour hours cent cents dollar dollars euro euros percent degrees mph kmh"
).split()


def plain(text: Column) -> Column:
    """White space as single blanks, without the characters that are marks here."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), f"[{NAME}-{FIRST}]", "")


def bare(text: Column) -> Column:
    """Small letters and digits of a text, and its blanks and marks; no blank stands beside another."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), f"[^\\p{{L}}\\p{{N}} {NAME}-{FIRST}]+", ""), " +", " "))


CAPITAL = "\\p{Lu}[^ \\p{N}]*+(?![^ ])"
INSIDE, STARTS = f"(?<=[^.!?: ] ){CAPITAL}", f"(?<![^ ])(?<![^.!?: ] ){CAPITAL}"


def tagged(df: DataFrame, *keys: str) -> DataFrame:
    """``keys, words`` from ``keys, text``: the words of each text, a placeholder as its mark with the word behind it."""
    out = F.regexp_replace(F.regexp_replace(plain(F.col("text")), INSIDE, f"{NAME}$0"), STARTS, f"{FIRST}$0")
    out = F.regexp_replace(bare(out), "(?<![^ ])[^ \\p{N}]*+\\p{N}[^ ]*", f"{NUMBER}$0")
    out = F.regexp_replace(out, f"({NUMBER}[^ ]* )((?:{'|'.join(UNITS)})(?![^ ]))", f"$1{UNIT}$2")
    return df.select(*keys, F.split(out, " ").alias("words")).select(*keys, F.when(F.col("words")[0] != "", F.col("words")).otherwise(F.array().cast("array<string>")).alias("words"))


def value(word: Column) -> Column:
    """The word behind a mark; a plain word as it is. Marks sort before all letters and digits."""
    return F.when(word < AFTER, F.substring(word, 2, 1 << 30)).otherwise(word)


def hashes(width: int, kind: str, parts: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(f"{kind}{width}"), *parts), F.xxhash64(F.lit(f"{width}{kind}"), *reversed(parts))]


def windows(df: DataFrame, keys: list[str], pos: str, width: int, as_values: str | None = None) -> DataFrame:
    """``keys, pos, h1, h2``: the windows of column ``words``, hashed, each from its first word on (``pos`` counts from 0).

    The values are hashed where the template is too general, and in rows whose column ``as_values``, one of the keys, is true. Where words that begin a
    sentence don't make the template too general as names, a second row has them as such. With ``as_values``, two more columns tell of each
    row whether its template is ``general`` and whether it is that second row (``names``).
    """
    shifted = [F.slice("words", i + 1, F.greatest(F.size("words") - (width - 1), F.lit(0))).alias(f"w{i}") for i in range(width)]
    # the outer form, as the optimizer adds to the plain one a filter that works out the words many times over
    rows = df.select(*keys, F.arrays_zip(*shifted).alias("zipped")).select(*keys, F.posexplode_outer("zipped").alias(pos, "w")).where(F.col(pos).isNotNull())
    # Step by step, so that each value is worked out once per window.
    at = range(width)
    rows = rows.select(*keys, pos, *[F.col(f"w.w{i}").alias(f"w{i}") for i in at])
    rows = rows.select(
        "*", *[(F.col(f"w{i}") < FIRST).alias(f"s{i}") for i in at], *[F.col(f"w{i}").between(FIRST, AFTER).alias(f"f{i}") for i in at],
        *[value(F.col(f"w{i}")).alias(f"v{i}") for i in at],
    )
    rows = rows.select(
        "*", *[F.when(F.col(f"s{i}"), F.substring(f"w{i}", 1, 1)).otherwise(F.col(f"v{i}")).alias(f"t{i}") for i in at],
        (width - sum((F.col(f"s{i}").cast("int") for i in at), F.lit(0))).alias("plain"), sum((F.col(f"f{i}").cast("int") for i in at), F.lit(0)).alias("begun"),
    )
    general, begun = F.col("plain") < LITERAL, (F.col("begun") > 0) & (F.col("plain") - F.col("begun") >= LITERAL)
    if as_values:
        general, begun = general | F.col(as_values), begun & ~F.col(as_values)
    as_words, told = (hashes(width, kind, [F.col(f"{kind}{i}") for i in at]) for kind in "tv")
    named = hashes(width, "t", [F.when(F.col(f"f{i}"), NAME).otherwise(F.col(f"t{i}")) for i in at])
    rows = rows.select(
        *keys, pos, general.alias("general"), *[F.when(general, v).otherwise(t).alias(name) for name, t, v in zip(("h1", "h2"), as_words, told)],
        *[F.when(begun, n).alias(name) for name, n in zip(("n1", "n2"), named)],
    )
    more = [[F.col("general"), F.lit(False).alias("names")], [F.lit(False).alias("general"), F.lit(True).alias("names")]] if as_values else [[], []]
    one, two = F.struct(*more[0], "h1", "h2"), F.struct(*more[1], F.col("n1").alias("h1"), F.col("n2").alias("h2"))
    return rows.select(*keys, pos, F.inline(F.when(F.col("n1").isNotNull(), F.array(one, two)).otherwise(F.array(one))))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, pos_i, window, width, h1, h2``: the windows of each item in all their forms; those that are the same have the same number ``window``.

    All items, in all forms, go through the windows of a width at once, and are written before they are compared.
    """
    small, values = (F.col("form") == name for name in ("small", "values"))
    cased = items.select("item_id", F.explode(F.array(F.lit("own"), F.lit("small"))).alias("form"), "text").withColumn("text", F.when(small, F.lower("text")).otherwise(F.col("text")))
    words = materialize(tagged(cased, "item_id", "form"), "item-words")
    forms = F.when(small, F.array("form")).otherwise(F.array(F.lit("own"), F.lit("values")))
    words = words.select("item_id", "words", F.explode(forms).alias("form")).withColumn("as_values", values)
    every = []
    for width in range(1, WIDTH + 1):
        fits = words.where(F.size("words") >= width if width == WIDTH else F.size("words") == width)
        every.append(windows(fits, ["item_id", "form", "as_values"], "pos_i", width, "as_values").withColumn("width", F.lit(width)))
    hashed = materialize(reduce(DataFrame.unionByName, every), "item-forms")
    plainly = hashed.where("form = 'own' AND NOT names")
    countable = plainly.groupBy("item_id").agg(F.bool_or(~F.col("general")).alias("countable"))
    listed = plainly.join(countable, "item_id").where(~F.col("general") | ~F.col("countable"))
    listed = listed.select("item_id", "pos_i", "width", F.min("pos_i").over(Window.partitionBy("item_id", "h1", "h2")).alias("window"))
    form = hashed.select("item_id", "pos_i", "width", "h1", "h2").distinct().join(listed, ["item_id", "pos_i", "width"])
    return form.select("item_id", F.col("pos_i").cast("int"), F.col("window").cast("int"), "width", "h1", "h2")


def found(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, coverage, slot_share`` of all documents that hold an item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    listed = materialize(item_windows(items), "item-windows")
    # an item's copies within a document keep apart by at least its length, so blocks of twice that length, half overlapping, hold each copy whole
    sizes = listed.groupBy("item_id", "width").agg(F.countDistinct("window").alias("n_windows"), (F.max("pos_i") + F.first("width")).alias("length"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = tagged(texts, "doc_id")
    widths = sorted(r["width"] for r in listed.select("width").distinct().collect())  # five at most
    mine = reduce(DataFrame.union, [windows(words, ["doc_id"], "pos_d", width) for width in widths or [WIDTH]])
    met = materialize(mine.join(listed, ["h1", "h2"]).select("doc_id", "pos_d", "item_id", "pos_i", "window"), "met")
    blocks = met.join(sizes, "item_id").withColumn("shift", F.col("pos_d") - F.col("pos_i") + F.col("length"))
    start = F.floor(F.col("shift") / F.col("length"))
    blocks = blocks.withColumn("block", F.explode(F.array(start, start - 1)))
    covered = blocks.groupBy("doc_id", "item_id", "block", "n_windows").agg(F.countDistinct("window").alias("n_matched"))
    covered = covered.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= share)
    covered = materialize(covered, "covered")
    slots = slot_shares(words, items, blocks, covered)
    judged = covered.join(slots, [covered.doc_id.eqNullSafe(slots.s_doc), covered.item_id == slots.s_item, covered.block == slots.s_block], "left")
    judged = judged.withColumn("slot_share", F.coalesce("slot_share", F.lit(1.0))).where(F.col("slot_share") >= share)
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "slot_share", "n_matched", "n_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.n_matched", "best.coverage", "best.slot_share")


def slot_shares(words: DataFrame, items: DataFrame, blocks: DataFrame, covered: DataFrame) -> DataFrame:
    """``s_doc, s_item, s_block, slot_share``: how consistently the slots of an item are filled in a document; none without slots."""
    slot = tagged(items, "item_id").select("item_id", F.posexplode("words").alias("at_i", "word"))
    slot = slot.where(F.col("word") < FIRST).select(F.col("item_id").alias("x_item"), "at_i", F.substring("word", 1, 1).alias("type"), value(F.col("word")).alias("asked"))
    slot = materialize(slot, "slots")
    pick = covered.select(F.col("doc_id").alias("c_doc"), F.col("item_id").alias("c_item"), F.col("block").alias("c_block"))
    # only items that have slots matter from here on
    pick = pick.join(slot.select(F.col("x_item").alias("c_item")).distinct(), "c_item", "left_semi")
    same = blocks.doc_id.eqNullSafe(pick.c_doc) & (blocks.item_id == pick.c_item) & (blocks.block == pick.c_block)
    kept = blocks.join(pick, same, "left_semi")
    # where windows of an item repeat, a place in the document meets several of the item: that of the shift on which most windows agree counts
    group = ["doc_id", "item_id", "block"]
    agree = kept.groupBy(*group, "shift").agg(F.countDistinct("pos_d").alias("agree"))
    kept = kept.join(agree.select(*(F.col(c).alias(f"a_{c}") for c in (*group, "shift")), "agree"), F.col("doc_id").eqNullSafe(F.col("a_doc_id")) & (F.col("item_id") == F.col("a_item_id")) & (F.col("block") == F.col("a_block")) & (F.col("shift") == F.col("a_shift")))
    at = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.struct((F.col("pos_i") + i).alias("i"), (F.col("pos_d") + i).alias("d")))
    aligned = kept.select(*group, "agree", F.explode(at).alias("at")).groupBy(*group, F.col("at.d").alias("d")).agg(F.max(F.struct("agree", "at.i")).alias("best"))
    aligned = aligned.select(*group, "best.i", "d")
    aligned = materialize(aligned.join(slot, (F.col("item_id") == F.col("x_item")) & (F.col("i") == F.col("at_i"))).drop("x_item", "at_i"), "aligned")
    wanted = aligned.select(F.col("doc_id").alias("w_doc")).distinct()
    told = words.join(wanted, words.doc_id.eqNullSafe(wanted.w_doc), "left_semi").select("doc_id", F.posexplode_outer("words").alias("at_d", "word"))
    told = told.groupBy(F.col("doc_id").alias("t_doc"), "at_d").agg(F.min(value(F.col("word"))).alias("told"))
    filled = aligned.join(told, aligned.doc_id.eqNullSafe(told.t_doc) & (aligned.d == told.at_d))
    counts = filled.groupBy("doc_id", "item_id", "block", "type", "asked", "told").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("doc_id", "item_id", "block", "type", "asked").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    total = most.groupBy("doc_id", "item_id", "block").agg((F.sum("most") / F.sum("all")).alias("slot_share"))
    return total.withColumnsRenamed({"doc_id": "s_doc", "item_id": "s_item", "block": "s_block"})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    held = materialize(found(docs, benchmark, share).select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return docs.join(held, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left_anti")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return found(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


OP3_SQL = f"""
WITH cut AS (
    SELECT side, id, list_filter(string_split(regexp_replace(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[\\x01-\\x04]', '', 'g'), ' '), lambda x: x <> '') AS raw FROM (
        SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
        UNION ALL SELECT 'i', item_id, coalesce(min(text), '') FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id
        UNION ALL SELECT 'l', item_id, lower(coalesce(min(text), '')) FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
), shown AS (
    SELECT side, id, list_transform(range(1, len(raw) + 1), lambda i: {{
        'v': regexp_replace(lower(raw[i]), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'cap': regexp_matches(raw[i], '^\\p{{Lu}}'),
        'inside': i > 1 AND NOT regexp_matches(raw[i - 1], '[.!?:]$')}}) AS x FROM cut
), kept AS (
    SELECT side, id, list_filter(x, lambda w: w.v <> '') AS x FROM shown
), kinds AS (
    SELECT side, id, x, list_transform(x, lambda w: CASE WHEN regexp_matches(w.v, '\\p{{N}}') THEN '<number>'
        WHEN w.cap AND w.inside THEN '<name>' WHEN w.cap THEN '<first>' ELSE '' END) AS kind FROM kept
), typed AS (
    SELECT side, id, list_transform(range(1, len(x) + 1), lambda i: {{'t': CASE WHEN kind[i] IN ('<name>', '<number>') THEN kind[i]
        WHEN i > 1 AND kind[i - 1] = '<number>' AND x[i].v IN ({', '.join(f"'{u}'" for u in UNITS)}) THEN '<unit>' ELSE x[i].v END,
        'f': kind[i] = '<first>', 'v': x[i].v}}) AS w FROM kinds
), forms AS (
    SELECT side, id, 't' AS form, w FROM typed
    UNION ALL SELECT side, id, 'n', list_transform(w, lambda x: {{'t': CASE WHEN x.f THEN '<name>' ELSE x.t END, 'f': x.f, 'v': x.v}}) FROM typed
    UNION ALL SELECT side, id, 'v', w FROM typed WHERE side = 'i'
), widths AS (
    SELECT DISTINCT least(len(w), {WIDTH}) AS width FROM typed WHERE side = 'i' AND len(w) > 0
), slices AS (
    SELECT side, id, form, width, y.pos, y.k, form = 'v' OR len(list_filter(y.k, lambda x: x.t NOT LIKE '<%')) < {LITERAL} AS general FROM (
        SELECT side, id, form, width, unnest(list_transform(range(len(w) - width + 1), lambda p: {{'pos': p, 'k': w[p + 1 : p + width]}})) AS y
        FROM forms JOIN widths ON CASE WHEN side = 'd' THEN len(w) >= width ELSE width = least(len(w), {WIDTH}) END)
    WHERE form <> 'n' OR (len(list_filter(y.k, lambda x: x.f)) > 0 AND len(list_filter(y.k, lambda x: x.t NOT LIKE '<%')) >= {LITERAL})
), windows AS (
    SELECT side, id, form, width, pos, general,
        CASE WHEN general THEN 'v' ELSE 't' END || width || list_aggregate(list_transform(k, lambda x: CASE WHEN general THEN x.v ELSE x.t END), 'string_agg', ' ') AS k FROM slices
), own AS (
    SELECT *, min(pos) OVER (PARTITION BY id, k) AS number FROM (
        SELECT *, bool_or(NOT general) OVER (PARTITION BY id) AS countable FROM windows WHERE side = 'i' AND form = 't') WHERE NOT general OR NOT countable
), listed AS (
    SELECT DISTINCT o.id AS item_id, o.pos AS pos_i, o.number, o.width, w.k FROM own o JOIN windows w ON w.id = o.id AND w.pos = o.pos AND w.side <> 'd'
), sizes AS (
    SELECT item_id, width, count(DISTINCT number) AS n_windows, max(pos_i) + width AS length FROM listed GROUP BY item_id, width
), met AS (
    SELECT w.id AS doc_id, item_id, pos AS pos_d, pos_i, number, n_windows, s.width, pos - pos_i + length AS shift, (pos - pos_i + length) // length AS block
    FROM windows w JOIN listed USING (k) JOIN sizes s USING (item_id) WHERE side = 'd'
), blocks AS (
    SELECT * FROM met UNION ALL SELECT * REPLACE (block - 1 AS block) FROM met
), covered AS (
    SELECT doc_id, item_id, block, n_windows, count(DISTINCT number) AS n_matched, count(DISTINCT number) / n_windows AS coverage
    FROM blocks GROUP BY doc_id, item_id, block, n_windows HAVING count(DISTINCT number) / n_windows >= {SHARE}
), agreeing AS (
    SELECT doc_id, item_id, block, shift, count(DISTINCT pos_d) AS agree FROM blocks GROUP BY ALL
), aligned AS (
    SELECT b.doc_id, b.item_id, b.block, pos_d + o AS d, max({{'agree': agree, 'i': pos_i + o}}).i AS i FROM blocks b
    JOIN covered c ON b.doc_id IS NOT DISTINCT FROM c.doc_id AND b.item_id = c.item_id AND b.block = c.block
    JOIN agreeing a ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.item_id = a.item_id AND b.block = a.block AND b.shift = a.shift
    JOIN range({WIDTH}) r(o) ON o < b.width GROUP BY b.doc_id, b.item_id, b.block, pos_d + o
), filled AS (
    SELECT a.doc_id, a.item_id, a.block, q.w[i + 1].t AS type, q.w[i + 1].v AS asked, x.w[d + 1].v AS told
    FROM aligned a JOIN typed q ON q.side = 'i' AND q.id = a.item_id JOIN typed x ON x.side = 'd' AND x.id IS NOT DISTINCT FROM a.doc_id
    WHERE q.w[i + 1].t LIKE '<%'
), shares AS (
    SELECT doc_id, item_id, block, sum(most) / sum(n) AS slot_share FROM (
        SELECT doc_id, item_id, block, type, asked, max(n) AS most, sum(n) AS n FROM (
            SELECT doc_id, item_id, block, type, asked, told, count(*) AS n FROM filled GROUP BY ALL) GROUP BY ALL) GROUP BY ALL
), judged AS (
    SELECT c.*, coalesce(slot_share, 1.0) AS slot_share FROM covered c
    LEFT JOIN shares s ON c.doc_id IS NOT DISTINCT FROM s.doc_id AND c.item_id = s.item_id AND c.block = s.block
)
SELECT doc_id, item_id, best.n_windows, best.n_matched, CAST(best.coverage AS DOUBLE) AS coverage, CAST(best.slot_share AS DOUBLE) AS slot_share FROM (
    SELECT doc_id, item_id, max({{'coverage': coverage, 'slot_share': slot_share, 'n_matched': n_matched, 'n_windows': n_windows}}) AS best
    FROM judged WHERE coalesce(slot_share, 1.0) >= {SHARE} GROUP BY doc_id, item_id)
"""
