"""Quality rules, lines first: bad lines go, then documents that lose too much.

Everything is built from column functions; nothing is shuffled. A line with
words fails if it
* is navigation: at least two separators, one for every four words or more;
* is symbols: over 5 % of its characters are of # * $ % & | < >;
* shouts: 20 capitals or more, and over 30 % of its characters;
* has 12 words or more without a sentence mark of any script, unless it is a
  part of wrapped text: a paragraph of two lines or more that has sentence
  marks, at the ends of half of its lines at most (Thai and Lao write none);
* is a short line of which whole boilerplate phrases make up a third or, for
  prompts to the reader, half;
* repeats an earlier line.
A document is rejected if over half of the characters of such lines go, or
if the base rules fail: fewer than 50 words, or over half of its words in
three-word windows found twice or more (windows are compared by 64-bit hash).

Defined cases: null text has no words and fails; blank lines count for nothing
and stay, but for those at the ends of a text that loses lines; a very long text or line is judged whole; a document that loses
just half stays; repeated documents are judged each; an empty table gives no
rows; columns named q_* are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import as_row

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_LINE_LOSS = 0.5
#: Phrases of boilerplate lines: notices, and prompts to the reader (fixed values).
NOTICES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies", "uses cookies", "enable javascript", "lorem ipsum",
    "política de privacidad", "todos los derechos reservados", "datenschutzerklärung", "alle rechte vorbehalten", "tous droits réservés", "politique de confidentialité",
)
PROMPTS = ("click here", "read more", "sign up", "log in", "subscribe", "share this", "powered by")
#: A line is boilerplate if its phrases, whole words with the characters beside them, make up one part in so many of it.
NOTICE_PART, PROMPT_PART = 3, 2
BOILERPLATE_MAX_CHARS = 200

#: Unicode's sentence terminals of the Basic Multilingual Plane, then dots, colons, semicolons and shads.
MARKS = (
    "!.?\u0589\u061d-\u061f\u06d4\u0700-\u0702\u07f9\u0837\u0839\u083d\u083e\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u166e\u1735\u1736\u17d4\u17d5\u1803\u1809\u1944\u1945"
    "\u1aa8-\u1aab\u1b5a\u1b5b\u1b5e\u1b5f\u1b7d\u1b7e\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047-\u2049\u2e2e\u2e3c\u2e53\u2e54\u3002\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f"
    "\ua9c8\ua9c9\uaa5d-\uaa5f\uaaf0\uaaf1\uabeb\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61"
    "\u2026:;\u037e\u061b\u0f0d-\u0f12\u1363-\u1366\ufe54\ufe55\uff1a\uff1b"
)
MARKED = rf"[{MARKS}\p{{IsThai}}\p{{IsLao}}]"
#: A line's end at a mark, with closing quotes and brackets.
MARKED_END = rf"(?md)[{MARKS}][\"'\u2019\u201d\u00bb\u300d\u300f)\]]*[\x20\x09\x0D]*$"
BLANK_LINES = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"

BLANK_ENDS = r"^(?:[\x20\x09\x0B-\x0D]*\n)+|(?:\n[\x20\x09\x0B-\x0D]*)+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(condition: Column) -> Column:
    """`condition`, computed where it stands: a filter on it isn't moved below the columns it is made of, which would compute them anew for each use."""
    return condition & (F.spark_partition_id() >= 0)


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_window_words(words: Column, n_words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""
    windows = F.when(n_words >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n_words - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    windows = F.coalesce(windows, F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(s) - 1)
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            twice = F.filter(at, lambda j: same(j, j - 1) | same(j, j + 1))
            return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        counted = F.aggregate(let(ordered, positions), start, step)["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(counted)

    return let(windows, covered)


def whole_words(phrases: tuple[str, ...]) -> str:
    """A pattern for the phrases between characters that aren't letters or digits."""
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(phrases)})(?:[^\p{{L}}\p{{N}}]|$)"


def boilerplate(line: Column) -> Column:
    """Phrases make up enough of a short line; lines without the letters of one are told at once."""
    low, size = F.lower(line), F.char_length(line)
    enough = lambda phrases, part: (size - F.char_length(F.regexp_replace(low, whole_words(phrases), ""))) * part >= size
    return F.when((size <= BOILERPLATE_MAX_CHARS) & low.rlike("|".join((*NOTICES, *PROMPTS))), enough(NOTICES, NOTICE_PART) | enough(PROMPTS, PROMPT_PART)).otherwise(False)


def line_fails(line: Column) -> Column:
    """The rules for one line with words, but for repetition and sentence marks."""
    n_chars = F.char_length(line)
    n_words = F.size(words_of(line))
    n_marks = F.regexp_count(line, F.lit(r"[|»›·•]"))
    n_symbols = n_chars - F.char_length(without(line, SYMBOLS))
    n_capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    return (
        ((n_marks >= 2) & (n_marks * 4 >= n_words))
        | (n_symbols * 20 > n_chars)
        | ((n_capitals >= 20) & (n_capitals * 10 > n_chars * 3))
        | boilerplate(line)
    )


def unmarked(line: Column) -> Column:
    """A line of 12 words or more without a sentence mark."""
    return ~line.rlike("[.!?:;]") & (F.size(words_of(line)) >= 12) & ~line.rlike(MARKED)  # the first, for speed


def wrapped_lines(text: Column, has_word: Callable[[Column], Column]) -> Column:
    """The lines of the paragraphs that are wrapped text."""

    def wrapped(paragraph: Column) -> Column:
        n_lines = F.size(F.filter(F.split(paragraph, "\n"), has_word))
        return (n_lines >= 2) & paragraph.rlike(MARKED) & (F.regexp_count(paragraph, F.lit(MARKED_END)) * 2 <= n_lines)

    return F.flatten(F.transform(F.filter(F.split(text, BLANK_LINES), wrapped), lambda p: F.split(p, "\n")))


def without_lines(lines: Column, bad: Column, has_word: Callable[[Column], Column]) -> Column:
    """The text of the lines that aren't bad and of the first of equal ones; blank lines between them stay where they are."""
    # A blank line is told apart by its number, after a line end that no line holds.
    told = F.transform(lines, lambda x, k: F.when(has_word(x), x).otherwise(F.concat(x, F.lit("\n"), k.cast("string"))))
    text = F.array_join(F.transform(F.array_except(F.array_distinct(told), bad), lambda x: F.substring_index(x, "\n", 1)), "\n")
    return F.regexp_replace(text, BLANK_ENDS, "")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with q_ columns: the base counts, base_failed, the cleaned text, the share of characters lost, kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    staged = docs.withColumns({"q_text": text}).withColumns({
        "q_words": words_of(F.col("q_text")),
        "q_lines": F.split("q_text", "\n"),
    })
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    staged = staged.withColumns({
        "q_n_words": F.size("q_words").cast("long"),
        "q_word_chars": F.char_length(without(F.col("q_text"), " \n\t\r\x0b\x0c")).cast("long"),
        "q_n_symbols": (F.char_length("q_text") - F.char_length(without(F.col("q_text"), SYMBOLS))).cast("long"),
        "q_n_repeat_words": repeated_window_words(F.col("q_words"), F.size("q_words")),
        "q_full": F.filter("q_lines", has_word),
    }).withColumn("q_unique", F.array_distinct("q_full"))
    staged = staged.withColumn("q_n_dup_lines", (F.size("q_full") - F.size("q_unique")).cast("long"))
    staged = staged.withColumn("q_unmarked", F.filter("q_unique", unmarked))
    lost = F.when(F.size("q_unmarked") > 0, F.array_except("q_unmarked", wrapped_lines(F.col("q_text"), has_word))).otherwise(F.col("q_unmarked"))
    good = F.filter("q_unique", lambda x: ~line_fails(x))
    staged = staged.withColumns({"q_lost": lost, "q_good": good})
    staged = staged.withColumn("q_good", F.when(F.size("q_lost") > 0, F.array_except("q_good", "q_lost")).otherwise(F.col("q_good")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x))
    staged = staged.withColumns({"q_all_chars": total("q_full"), "q_good_chars": total("q_good")})
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    staged = staged.withColumns({
        "q_base_failed": failed,
        "q_line_loss": F.when(F.col("q_all_chars") > 0, F.round(1 - F.col("q_good_chars") / F.col("q_all_chars"), 6)).otherwise(F.lit(0.0)),
        "q_cleaned": F.when((F.size("q_good") == F.size("q_full")), F.col("q_text")).otherwise(without_lines(F.col("q_lines"), F.array_except("q_unique", "q_good"), has_word)),
    })
    kept = ~F.col("q_base_failed") & (F.col("q_good_chars") >= (1 - MAX_LINE_LOSS) * F.col("q_all_chars"))
    return staged.withColumn("q_kept", settled(kept)).drop("q_text", "q_words", "q_lines", "q_full", "q_unique", "q_unmarked", "q_lost", "q_good")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts and the verdict."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_loss")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return measure(rows).select("doc_id", *(F.col(f"q_{n}").alias(n) for n in names))


def keep_good(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The kept documents with their good lines; `length_col` follows the text where it exists."""
    kept = measure(as_row(docs, text=text_col)).filter("q_kept")
    changed = {text_col: F.col("q_cleaned")}
    if length_col in docs.columns:
        changed[length_col] = F.char_length("q_cleaned").cast(docs.schema[length_col].dataType)
    return kept.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
