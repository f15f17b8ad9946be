"""Quality rules, line first; DataFrame functions only.

Lines (split at line breaks) are judged one by one. A line goes when

* punctuation: it is mostly symbols or mostly punctuation, or holds a row of dots or dashes;
* navigation: it is a bar of short items, or has several links;
* boilerplate: it is short and holds a notice (in four languages), it is mostly
  shouting, it is padding, or it repeats an earlier line of the document.

Lines without words are layout and stay. A document that lost too much of its text, or
that fails the base rules on its whole text, is rejected. No rule looks at a missing
sentence end: headings, verses and lists have none. Everything is computed within the
row: no shuffle, no Python, one pass; windows are held as 64-bit hashes, 8 bytes a word.

A null or empty text has no words: all counts 0, ``base_failed`` true, not kept. Repeated
rows give equal rows. ``measure`` returns its own columns only; ``clean`` returns the
columns of its input, whatever their names: they travel in a struct of their own, and
only ``text`` and ``n_chars`` change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules (shares in percent of a line's or text's characters)."""

    min_words: int = 20
    max_repeat_share: int = 30
    window: int = 8
    max_symbol_share: int = 12
    max_punctuation_share: int = 50
    min_shout_letters: int = 12
    max_shout_share: int = 90
    max_bars: int = 3
    max_links: int = 2
    notice_words: int = 16
    #: A document is rejected when its failed lines hold more of its characters.
    max_lost_share: int = 40


#: Short lines with one of these are notices, not text.
NOTICES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "accept cookies", "click here", "read more", "sign up", "sign in", "log in", "subscribe now", "share this",
    "skip to content", "back to top", "enable javascript", "lorem ipsum",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl", "verwendet cookies", "hier klicken", "weiterlesen", "jetzt anmelden", "nach oben",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "cliquez ici", "lire la suite", "se connecter", "haut de page",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utiliza cookies", "haga clic aquí", "leer más", "iniciar sesión", "volver arriba",
]

#: The same word six times in a row. A line that does so twice is padding; once may be chance.
STUTTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?: \1){5}(?![^\x20\x09-\x0D])"
PADDING = STUTTER + ".*?" + STUTTER.replace(r"\1", r"\2")
#: Two capitals in a row: without them no line shouts.
CAPITALS = r"\p{Lu}\p{Lu}"
SYMBOLS = r"#*$%&|<>"
#: A row of dots or dashes, as in tables of contents and dividing lines.
ROW = r"[.…_=~–—-]{6}"
#: A line that is mostly punctuation has two such characters next to each other or one apart, or is one; so has a row.
DENSE = r"[\p{P}=~][\s\S]?[\p{P}=~]|(?m:^\p{P}$)"
LINK = r"https?://|www\."
#: A navigation bar: at least five items of at most three words between separators.
_ITEM = r" *[^ |»›•·]+(?: +[^ |»›•·]+){0,2} *"
BAR = rf"(?:^|[|»›•·]){_ITEM}(?:[|»›•·]{_ITEM}){{4}}"


def count_of(text: Column, kind: str) -> Column:
    """Characters of a class in the text."""
    return F.length(F.regexp_replace(text, f"[^{kind}]++", ""))


def line_fails(line: Column, rules: Rules = Rules()) -> Column:
    """Whether a line goes, by itself."""
    chars = F.length(line)
    letters = count_of(line, r"\p{L}")
    shouts = line.rlike(CAPITALS) & (letters >= rules.min_shout_letters) & (count_of(line, r"\p{Lu}") * 100 > letters * rules.max_shout_share)
    notice = (F.size(F.split(F.trim(line), " +")) <= rules.notice_words) & F.lower(line).rlike("|".join(NOTICES))
    dense = (count_of(line, SYMBOLS) * 100 > chars * rules.max_symbol_share) | (count_of(line, r"\p{P}") * 100 > chars * rules.max_punctuation_share) | line.rlike(ROW)
    bars = (count_of(line, r"|") > rules.max_bars) | line.rlike(BAR) | (F.regexp_count(line, F.lit(LINK)) > rules.max_links)
    return dense | shouts | bars | line.rlike(PADDING) | notice


def suspect(text: Column, joined: Column, n_symbols: Column) -> Column:
    """False only where no line can fail by itself, so that most texts are not judged line by line."""
    small = F.lower(text)
    found = (n_symbols > 0) | text.rlike(CAPITALS) | text.rlike(DENSE) | joined.rlike(STUTTER)
    for x in ("http", "www.", "»", "›", "•", "·"):
        found = found | F.contains(text, F.lit(x))
    for x in NOTICES:
        found = found | F.contains(small, F.lit(x))
    return found


def doubled(hashes: Column, n: Column, width: int) -> Column:
    """Hashes of windows of twice ``width`` words from those of ``width``; the last ones reach over the end. ``hashes`` must be a column."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(width + 1), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))


def ordered(hashes: Column) -> Column:
    """Hashes with their positions, sorted; null where all differ."""
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def marked_places(pairs: Column) -> Column:
    """Positions whose hash has an equal neighbour. ``pairs`` must be a column: the lambda reads it per element."""
    last = F.size(pairs) - 1
    near = F.filter(pairs, lambda x, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(pairs, k + 1)["h"] == x["h"])))
    return F.sort_array(F.transform(near, lambda x: x["i"]))


def later_flags(pairs: Column) -> Column:
    """For every position, in order: struct(i, whether its hash stands earlier too). ``pairs`` must be a column."""
    return F.sort_array(F.transform(pairs, lambda x, k: F.struct(x["i"].alias("i"), ((k > 0) & F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False))).alias("again"))))


def united(places: Column, window: int) -> Column:
    """Words in the union of the windows that start at ``places``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(places, zero, lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judged(df: DataFrame, rules: Rules) -> DataFrame:
    """(row, cleaned, lost_chars, COUNTS) from (row, text without nulls)."""
    text, worded = F.col("text"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    if rules.window not in (2, 4, 8, 16, 32):
        raise ValueError("the window must be a power of two")
    df = df.select("row", "text", F.array_remove(F.split(text, SPACE + "++"), "").alias("words"), F.split(text, "\n", -1).alias("lines"))
    df = df.select(
        "row", "text", "lines", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("joined"), F.transform("words", lambda w: F.xxhash64(w)).alias("windows"),
        # lines without words count as different from all others
        F.transform("lines", lambda line, i: F.when(worded(line), F.xxhash64(line)).otherwise(F.xxhash64(F.lit("empty"), i))).alias("line_hashes"), count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    width = 1
    while width < rules.window:
        df = df.withColumn("windows", doubled(F.col("windows"), F.col("n_words").cast("int"), width))
        width *= 2
    df = df.withColumn("windows", F.slice("windows", F.lit(1), F.greatest(F.col("n_words").cast("int") - (width - 1), F.lit(0))))
    df = df.select(
        "row", "text", "lines", "n_words", "n_symbols", ordered(F.col("windows")).alias("pairs"), ordered(F.col("line_hashes")).alias("line_pairs"),
        (F.length("joined") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"), suspect(text, F.col("joined"), F.col("n_symbols")).alias("open"),
        (F.size("line_hashes") - F.size(F.array_distinct("line_hashes"))).cast("long").alias("n_dup_lines"),
    )
    df = df.select(
        "row", "text", "lines", "n_words", "n_symbols", "word_chars", "n_dup_lines", "open", later_flags(F.col("line_pairs")).alias("flags"),
        F.coalesce(united(marked_places(F.col("pairs")), rules.window), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    once = F.when(F.col("n_dup_lines") > 0, F.transform(F.filter(F.zip_with("lines", "flags", lambda line, f: F.struct(line.alias("line"), f["again"].alias("again"))), lambda x: ~x["again"]), lambda x: x["line"])).otherwise(F.col("lines"))
    df = df.withColumn("left", once).drop("lines", "flags")
    cleaned = F.when(F.col("open"), F.array_join(F.filter("left", lambda line: ~line_fails(line, rules) | ~worded(line)), "\n")).when(F.col("n_dup_lines") > 0, F.array_join("left", "\n")).otherwise(text)
    df = df.withColumn("cleaned", cleaned).drop("left", "open")
    lost = F.when(F.col("cleaned") == text, 0).otherwise(F.col("word_chars") - F.length(F.regexp_replace("cleaned", SPACE + "++", ""))).cast("long")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words"))
    df = df.withColumns({"lost_chars": lost, "base_failed": failed}).drop("text")
    return df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.max_lost_share * F.col("word_chars")))


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, the verdict, ``lost_chars`` and the ``cleaned`` text of every row; other columns are ignored."""
    df = docs.select(F.col("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return judged(df, rules).select(F.col("row").alias("doc_id"), *COUNTS, "lost_chars", "cleaned")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents with their failed lines removed; same columns as ``docs``.

    Rejected rows fall away by a generator: a filter would be pushed below the steps that
    compute the verdict, with all of them written into each other.
    """
    df = judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text")), rules)
    df = df.select("row", F.explode(F.when(F.col("kept"), F.array("cleaned"))).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).drop("cleaned")
