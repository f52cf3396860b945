"""Benchmark decontamination by canonical templates, in built-in functions alone.

Numbers, names and units become typed placeholders, so a question whose parameters were replaced
keeps its template. Windows of five template words are joined by hash with those of the benchmark;
a document that holds enough of an item's windows is a candidate, and stays one if its slots fit:
each value of the item must stand for one value of the document, and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.session import durable

#: Placeholders, from the private-use area; such characters in a text are taken out first.
NUMBER_MARK, NAME_MARK, UNIT_MARK = "\ue000", "\ue001", "\ue002"
#: The end of a name, the start of a word that opens a sentence and may be one, a blank inside a name.
NAME_END, OPEN_MARK, JOIN_MARK = "\ue003", "\ue004", "\ue005"
KINDS = NUMBER_MARK + NAME_MARK + UNIT_MARK
MARKS = KINDS + NAME_END + OPEN_MARK + JOIN_MARK
#: Words that open sentences and are no names.
OPENERS = (
    "A", "After", "All", "Although", "An", "And", "Are", "As", "At", "Because", "Before", "Both", "But", "By", "Calculate",
    "Can", "Compute", "Could", "Did", "Do", "Does", "During", "Each", "Every", "Find", "For", "From", "Given", "Had",
    "Has", "Have", "He", "Her", "His", "How", "I", "If", "In", "Is", "It", "Its", "Let", "Many", "My", "No", "Not", "Now",
    "Of", "On", "One", "Or", "Our", "She", "Should", "Since", "So", "Some", "Suppose", "That", "The", "Their", "Then",
    "There", "These", "They", "This", "Those", "Though", "To", "Two", "Until", "Was", "We", "Were", "What", "When", "Where",
    "Which", "While", "Who", "Whose", "Why", "Will", "With", "Would", "You", "Your",
)
_CAPITALISED = r"\p{Lu}\p{Ll}[\p{L}\p{M}]*"
#: A capitalised word inside a sentence (first group), or one that opens a sentence (second). No pattern
#: repeats a group: on a long run of names or numbers Java would go as deep as the run is long.
NAME_WORD = (
    rf"(?=\p{{Lu}})(?:(?<=[\p{{L}}\p{{M}}0-9,;] )({_CAPITALISED})"
    rf"|(?<![\p{{L}}\p{{M}}])(?!(?:{'|'.join(OPENERS)})(?![\p{{L}}\p{{M}}]))({_CAPITALISED}))"
)
#: The two readings: words that open sentences stand as they are, or are names.
PLAIN, NAMED = 0, 1
#: What holds the names of a text, by reading.
HELD = (rf"[{NAME_MARK}{JOIN_MARK}]([^{NAME_END}]*){NAME_END}", rf"[{NAME_MARK}{OPEN_MARK}]([^{NAME_END}]*){NAME_END}")
#: A number, or several with no word between them.
NUMBER = rf"[0-9](?:[^\p{{L}}\p{{M}}{NAME_MARK}]*[0-9])?"
UNITS = (
    "km", "kilometers", "kilometres", "m", "meters", "metres", "cm", "mm", "miles", "mile", "feet", "foot", "ft",
    "inches", "inch", "yards", "kg", "kilograms", "g", "grams", "mg", "pounds", "lb", "ounces", "oz", "tons", "l",
    "liters", "litres", "ml", "gallons", "seconds", "second", "s", "minutes", "minute", "min", "hours", "hour", "h",
    "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "euros", "euro",
    "usd", "eur", "percent", "degrees", "kmh", "mph", "kw", "kwh", "w", "v", "hz", "mb", "gb",
)
UNIT = rf"({NUMBER_MARK} +)({'|'.join(UNITS)})([^\p{{L}}\p{{M}}]|$)"
BREAK = rf"[^\p{{L}}\p{{M}}{KINDS}{OPEN_MARK}{JOIN_MARK}]+"
WINDOW, SHARE = 5, 0.8
#: Up to this many benchmark windows or candidate ids are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def _steps(text: Column) -> tuple[Column, Column, Column, Column]:
    """The text with names marked, with them replaced, and with numbers, then units too replaced.

    Words that open sentences keep their letters behind a mark, so one chain serves both readings.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), MARKS, "")
    marked = F.regexp_replace(clean, NAME_WORD, f"{NAME_MARK}$1{OPEN_MARK}$2{NAME_END}")
    for old, new in ((NAME_MARK + OPEN_MARK, OPEN_MARK), (OPEN_MARK + NAME_END, NAME_END), (f"{NAME_END} {NAME_MARK}", JOIN_MARK)):
        marked = F.replace(marked, F.lit(old), F.lit(new))  # names in a row are one
    named = F.lower(F.regexp_replace(marked, f"([{NAME_MARK}{JOIN_MARK}])[^{NAME_END}]*{NAME_END}|{NAME_END}", " $1"))
    numbered = F.regexp_replace(named, NUMBER, f" {NUMBER_MARK} ")
    return marked, named, numbered, F.regexp_replace(numbered, UNIT, f"$1{UNIT_MARK}$3")


def _words(done: Column) -> Column:
    """The words of a text with all marks; NULL and wordless texts have none."""
    return F.array_remove(F.split(done, BREAK), "")


def _read(words: Column, reading: int) -> Column:
    """The words of the template in one reading."""
    opens = lambda x: x.startswith(OPEN_MARK)
    if reading == NAMED:
        return F.transform(F.array_remove(words, JOIN_MARK), lambda x: F.when(opens(x), F.lit(NAME_MARK)).otherwise(x))
    return F.transform(
        words, lambda x: F.when(opens(x), F.substr(x, F.lit(2))).when(x == JOIN_MARK, F.lit(NAME_MARK)).otherwise(x)
    )


def template(text: Column, reading: int = PLAIN) -> Column:
    """The words of a text's template; NULL and wordless texts have none."""
    return _read(_words(_steps(text)[3]), reading)


def _windows(texts: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, reading, position, h): hashes of the windows of every text in both readings, from one chain.

    A template shorter than a window is a window of its own, an empty one has none.
    """
    worded = texts.select(*keys, _words(_steps(F.col("text"))[3]).alias("w"))
    readings = F.array(*[F.struct(F.lit(r).alias("reading"), _read(F.col("w"), r).alias("v")) for r in (PLAIN, NAMED)])
    both = worded.select(*keys, F.explode(readings).alias("x")).select(*keys, "x.reading", "x.v")
    # Shifted copies of the words side by side: the hash stays within generated code.
    shifted = F.arrays_zip("v", *[F.slice("v", k + 1, (1 << 31) - 1).alias(f"v{k}") for k in range(1, WINDOW)])
    words = both.select(*keys, "reading", F.posexplode(shifted).alias(position, "z"))
    whole = words.filter((F.col(position) == 0) | F.col("z")[f"v{WINDOW - 1}"].isNotNull())
    return whole.select(*keys, "reading", position, F.xxhash64("z.v", *[F.col("z")[f"v{k}"] for k in range(1, WINDOW)]).alias("h"))


def _slots(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reading, p, kind, value): the value that each placeholder of a template stands for."""
    marked, named, numbered, done = _steps(F.col("text"))
    found = texts.select(
        *keys, _words(done).alias("w"), F.regexp_extract_all(named, F.lit(NUMBER), 0).alias("numbers"),
        F.regexp_extract_all(numbered, F.lit(UNIT), 2).alias("units"),
        *[F.regexp_extract_all(marked, F.lit(HELD[r]), 1).alias(f"names{r}") for r in (PLAIN, NAMED)],
    )
    sides = []
    for r in (PLAIN, NAMED):
        at = found.select(*keys, F.posexplode(_read(F.col("w"), r)).alias("p", "kind")).filter(F.col("kind").isin(*KINDS))
        at = at.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("p")) - 1)
        values = None
        for kind, held in ((NAME_MARK, f"names{r}"), (NUMBER_MARK, "numbers"), (UNIT_MARK, "units")):
            own = found.select(*keys, F.lit(kind).alias("kind"), F.posexplode(held).alias("k", "value"))
            values = own if values is None else values.unionByName(own)
        value = F.lower(F.replace("value", F.lit(JOIN_MARK), F.lit(" ")))
        sides.append(at.join(values, [*keys, "kind", "k"]).select(*keys, F.lit(r).alias("reading"), "p", "kind", value.alias("value")))
    return sides[0].unionByName(sides[1])


def small(side: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, by count."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", share: float = SHARE) -> DataFrame:
    """(document id, item id, windows found over windows of the item, whether a slot changed).

    Items of equal text count once, as the least id; items without a word or an id are left out.
    Each text of a document id is judged by itself, and the id has the leaks of all its texts, the
    one of largest coverage of several; rows without an id are never flagged here.
    A passage may stand several times in a document. The slots are checked at each place that holds
    enough windows of its own, and at the one with most of them; it is enough that one fits, and of
    those that fit the one with most windows, the first of several, tells what changed.
    Whether a word that opens a sentence is a name cannot be seen: what is no leak with such words
    as they stand is read again with them as names, in the document and the item.
    """
    items = (
        benchmark.select(benchmark[item].alias("item"), benchmark["text"].alias("text"))
        .filter("item IS NOT NULL AND text IS NOT NULL").groupBy("text").agg(F.min("item").alias("item"))
    )
    wanted = durable(_windows(items, ["item"], "ipos"))
    sizes = wanted.groupBy("reading", "item").agg(F.count("*").alias("n"))
    own = docs.select(docs[key].alias("id"), docs["text"].alias("text")).filter("id IS NOT NULL")
    own = own.select(F.struct("id", F.xxhash64("text").alias("print")).alias("doc"), "text")
    # Only windows of the benchmark pass this join; all that follows is as large as the leaks are.
    found = durable(
        _windows(own, ["doc"], "pos").join(small(wanted), ["reading", "h"])
        .select("reading", "doc", "item", "ipos", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    )
    pair = ["reading", "doc", "item"]
    enough = (
        found.groupBy(*pair).agg(F.countDistinct("ipos").alias("hits"))
        .join(sizes, ["reading", "item"]).filter(F.col("hits") >= share * F.col("n"))
        .select(*pair, (F.col("hits") / F.col("n")).alias("coverage"))
    )
    places = found.groupBy(*pair, "shift").agg(F.count("*").alias("m"))
    best = places.groupBy(*pair).agg(F.max_by("shift", F.struct("m", -F.col("shift"))).alias("best"))
    aligned = (
        places.join(sizes, ["reading", "item"]).join(best, pair)
        .filter((F.col("m") >= share * F.col("n")) | (F.col("shift") == F.col("best"))).select(*pair, "shift", "m")
    )
    candidates = durable(enough.join(aligned, pair))
    texts = own.join(small(candidates.select("doc").distinct()), "doc").groupBy("doc").agg(F.min("text").alias("text"))
    theirs = _slots(texts, ["doc"])
    ours = _slots(items, ["item"]).select("reading", "item", F.col("p").alias("q"), "kind", F.col("value").alias("ivalue"))
    bound = (
        candidates.join(ours, ["reading", "item"]).withColumn("p", F.col("q") + F.col("shift"))
        .join(theirs, ["reading", "doc", "p", "kind"]).groupBy(*pair, "shift").agg(
            F.count("*").alias("slots"),
            F.sum((F.col("ivalue") == F.col("value")).cast("int")).alias("same"),
            F.countDistinct("kind", "ivalue").alias("left"),
            F.countDistinct("kind", "value").alias("right"),
            F.countDistinct("kind", "ivalue", "value").alias("both"),
        )
    )
    fits = (F.col("left") == F.col("both")) & (F.col("right") == F.col("both")) | (F.col("same") >= share * F.col("slots"))
    judged = (
        candidates.join(bound, [*pair, "shift"], "left").filter(F.col("slots").isNull() | fits)
        .groupBy(*pair).agg(
            F.max("coverage").alias("coverage"),
            F.max_by(F.coalesce(F.col("same") < F.col("slots"), F.lit(False)), F.struct("m", -F.col("shift"))).alias("changed"),
        )
    )
    first = judged.groupBy("doc", "item").agg(F.min_by(F.struct("coverage", "changed"), "reading").alias("x"))
    ids = first.groupBy(F.col("doc.id").alias(key), F.col("item").alias(item))
    return ids.agg(F.max("x").alias("x")).select(key, item, "x.coverage", "x.changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per document row: whether it is contaminated, by which items, and how.

    ``coverage`` is the largest share of an item's windows, 0 without one; ``changed`` tells whether
    an item was met with other parameters. An empty benchmark flags nothing.
    """
    flagged = (
        leaks(docs, benchmark, key, item).groupBy(key)
        .agg(
            F.sort_array(F.collect_set(item)).alias("items"),
            F.max("coverage").alias("coverage"),
            F.max("changed").alias("changed"),
        )
    )
    none = F.array().cast(f"array<{dict(benchmark.dtypes)[item]}>")
    return docs.select(key).join(flagged, key, "left").select(
        key,
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("changed", F.lit(False)).alias("changed"),
    )


def oracle_sql() -> str:
    """The same in DuckDB, on the words of the windows in place of their hashes.

    Its patterns know no look-behind but may repeat groups.
    """
    name = r"\p{Lu}\p{Ll}[\p{L}\p{M}]*"
    opening = rf"(^|^ |[^\p{{L}}\p{{M}} ]|[^\p{{L}}\p{{M}}0-9,;] )({name})"
    inner = rf"([\p{{L}}\p{{M}}0-9,;{NAME_END}] )({name}(?: {name})*)"
    clean = f"translate(coalesce(text, ''), '{MARKS}', '')"
    opened = f"regexp_replace({clean}, '{opening}', '\\1{OPEN_MARK}\\2{NAME_END}', 'g')"
    listed = f"regexp_replace({opened}, '{OPEN_MARK}({'|'.join(OPENERS)}){NAME_END}', '\\1', 'g')"
    marked = f"replace(regexp_replace({listed}, '{inner}', '\\1{NAME_MARK}\\2{NAME_END}', 'g'), '{NAME_END} {NAME_MARK}', '{JOIN_MARK}')"
    held = [
        f"translate(regexp_replace(a, '[{JOIN_MARK}{NAME_MARK}][^{NAME_END}]*{NAME_END}', ' {NAME_MARK}', 'g'), '{OPEN_MARK}{NAME_END}', '')",
        f"regexp_replace(a, '[{OPEN_MARK}{NAME_MARK}][^{NAME_END}]*{NAME_END}', '{NAME_MARK}', 'g')",
    ]
    numbered = f"regexp_replace(b, '{NUMBER}', ' {NUMBER_MARK} ', 'g')"
    done = f"regexp_replace(c, '{UNIT}', '\\1{UNIT_MARK}\\3', 'g')"

    def words(source, key):
        return " UNION ALL ".join(f"""
  SELECT {r} AS reading, {key}, b, c, list_filter(string_split_regex({done}, '{BREAK}'), lambda x: x <> '') AS w,
    regexp_extract_all(a, '{HELD[r]}', 1) AS names FROM (
    SELECT *, {numbered} AS c FROM (SELECT *, lower({held[r]}) AS b FROM (SELECT *, {marked} AS a FROM {source})))""" for r in (PLAIN, NAMED))

    def windows(source, key, pos):
        return f"""
  SELECT reading, {key}, i AS {pos}, w[i + 1 : i + {WINDOW}] AS h FROM (
    SELECT reading, {key}, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM {source} WHERE len(w) > 0)"""

    def slots(source, key, pos):
        return f"""
  SELECT reading, {key}, p AS {pos}, kind, lower(replace(CASE kind WHEN '{NAME_MARK}' THEN names WHEN '{NUMBER_MARK}' THEN numbers ELSE units END[
      row_number() OVER (PARTITION BY reading, {key}, kind ORDER BY p)], '{JOIN_MARK}', ' ')) AS v_{pos}
  FROM (SELECT reading, {key}, names, regexp_extract_all(b, '{NUMBER}') AS numbers,
      regexp_extract_all(c, '{UNIT}', 2) AS units, unnest(range(len(w))) AS p, unnest(w) AS kind FROM {source})
  WHERE kind IN ('{NUMBER_MARK}', '{NAME_MARK}', '{UNIT_MARK}')"""

    return f"""
WITH items AS (SELECT text, min(item_id) AS item FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY text),
own AS (SELECT DISTINCT doc_id, text, row(doc_id, md5(text)) AS doc FROM documents WHERE doc_id IS NOT NULL),
iw AS MATERIALIZED ({words("items", "item")}),
dw AS MATERIALIZED ({words("own", "doc")}),
wanted AS ({windows("iw", "item", "ipos")}),
seen AS MATERIALIZED ({windows("dw", "doc", "pos")}),
found AS MATERIALIZED (SELECT DISTINCT reading, doc, item, ipos, pos - ipos AS shift FROM seen JOIN wanted USING (reading, h)),
sizes AS (SELECT reading, item, count(*) AS n FROM wanted GROUP BY ALL),
enough AS (
  SELECT reading, doc, item, count(DISTINCT ipos) / any_value(n) AS coverage FROM found JOIN sizes USING (reading, item)
  GROUP BY reading, doc, item HAVING count(DISTINCT ipos) >= {SHARE} * any_value(n)),
aligned AS (
  SELECT reading, doc, item, shift, m FROM (SELECT reading, doc, item, shift, count(*) AS m FROM found GROUP BY ALL)
  JOIN sizes USING (reading, item)
  QUALIFY m >= {SHARE} * n OR row_number() OVER (PARTITION BY reading, doc, item ORDER BY m DESC, shift) = 1),
candidates AS (SELECT * FROM enough JOIN aligned USING (reading, doc, item)),
ours AS ({slots("iw", "item", "q")}),
theirs AS ({slots("(SELECT * FROM dw WHERE doc IN (SELECT doc FROM enough))", "doc", "p")}),
bound AS (
  SELECT c.reading, c.doc, c.item, c.shift, count(*) AS slots, sum((v_q = v_p)::INT) AS same, count(DISTINCT (o.kind, v_q)) AS l,
    count(DISTINCT (o.kind, v_p)) AS r, count(DISTINCT (o.kind, v_q, v_p)) AS lr
  FROM candidates c JOIN ours o ON o.reading = c.reading AND o.item = c.item
  JOIN theirs t ON t.reading = c.reading AND t.doc = c.doc AND t.p = o.q + c.shift AND t.kind = o.kind GROUP BY ALL),
judged AS (
  SELECT reading, doc, item, max(coverage) AS coverage, first(coalesce(same < slots, false) ORDER BY m DESC, shift) AS changed
  FROM candidates LEFT JOIN bound USING (reading, doc, item, shift)
  WHERE slots IS NULL OR (l = lr AND r = lr) OR same >= {SHARE} * slots GROUP BY ALL),
leaks AS (
  SELECT doc, item, first(coverage ORDER BY reading) AS coverage, first(changed ORDER BY reading) AS changed FROM judged GROUP BY ALL),
flagged AS (
  SELECT doc_id, list_sort(list(DISTINCT item)) AS items, max(coverage) AS coverage, max(changed) AS changed FROM (
    SELECT doc_id, item, unnest(max(row(coverage, changed)), max_depth := 1)
    FROM (SELECT own.doc_id, leaks.* FROM leaks JOIN own USING (doc)) GROUP BY doc_id, item) t(doc_id, item, coverage, changed)
  GROUP BY doc_id)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(items, []) AS items, coalesce(coverage, 0.0)::DOUBLE AS coverage,
  coalesce(changed, false) AS changed
FROM documents LEFT JOIN flagged USING (doc_id)"""
