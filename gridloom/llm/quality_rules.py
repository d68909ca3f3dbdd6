"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule rejects documents by one or two measurements. On a sample of about SAMPLE_ROWS rows from all over the table
the cost and the selectivity (share rejected) of every rule are estimated in one pass: its cost is the code points and
words that its measurements walk over there, each at a fixed price by kind of walk, so that one table always gives one
order. The rules are put in order of rejections per cost. The cascade is one lazy expression over a text and its words, which are split once: a CASE whose
branches hold the rules' own measurements, so a dear one is only taken of what the cheaper rules let pass. The order
never changes which documents are kept, only which rule names them.

Defined cases: a null or empty text has no words and fails `few_words`; repeated rows are judged alike; an
empty table gives an empty table; columns besides the id and the text are ignored by `judge`, and kept as
they are by `keep`; texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of the sample on which cost and selectivity are measured; it sets the order of the rules, nothing else.
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    """name; the SQL condition, over the measurements, under which a document is rejected; the same as a Column, of a function from a measurement's name to its Column."""

    name: str
    rejects: str
    test: Callable[[Callable[[str], Column]], Column]
    per_text: float = 0.0  # prices, in nanoseconds as measured on prose once the words are split
    per_char: float = 0.0
    per_word: float = 0.0


#: The first two are the base rules.
RULES = (
    Rule("few_words", "n_words < 20", lambda m: m("n_words") < 20, per_text=20),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"), per_text=500, per_word=1000),
    Rule("symbols", "10 * n_symbols > n_words", lambda m: 10 * m("n_symbols") > m("n_words"), per_text=100, per_char=85),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", lambda m: bind(m("lines"), lambda x: (F.size(x) >= 4) & (2 * _doubles(x) > F.size(x))), per_text=400, per_char=26),
    Rule("stutter", "10 * n_stutter > 3 * n_words", lambda m: 10 * m("n_stutter") > 3 * m("n_words"), per_text=300, per_word=150),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", lambda m: bind(m("word_chars"), lambda x: (x < 2 * m("n_words")) | (x > 20 * m("n_words"))), per_text=100, per_char=83),
)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _doubles(x: Column) -> Column:
    """Elements equal to an earlier one."""
    return (F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _stutter(w: Column) -> Column:
    """Words equal to the one before."""
    same = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: a == b)
    return F.when(F.size(w) > 1, F.size(F.filter(same, lambda x: x))).otherwise(0).cast("long")


def measurement(name: str, t: Column, w: Column) -> Column:
    """A measurement of a text t with words w; `lines`: its lines with a word."""
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return {
        "n_words": lambda: F.size(w).cast("long"),
        "word_chars": lambda: F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": lambda: (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "lines": lambda: lines,
        "n_stutter": lambda: _stutter(w),
        "n_repeat_words": lambda: _repeat_words(w, F.size(w)),
    }[name]()


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in WINDOW-word windows found twice or more in the text, the first of them included."""
    def covered(starts: Column) -> Column:
        steps = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda acc, x: acc + x)

    def starts(s: Column) -> Column:
        # equal windows stand side by side once sorted; starts of repeated ones, back in text order
        same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bind(bind(pairs, starts), covered)).otherwise(F.lit(0).cast("long"))

    # element by element: slice() inside a lambda would copy the whole array each time
    windows = lambda wh: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[wh[i + j] for j in range(WINDOW)]))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n > WINDOW, bind(bind(hashed, windows), repeated)).otherwise(F.lit(0).cast("long"))


def rejection(rules: list[Rule] | tuple[Rule, ...], text: Column) -> Column:
    """The cascade: the name of the first rule that rejects the text; null: none does. A rule's measurements are worked out only if those before it let the text pass."""

    def first(v: Column) -> Column:
        of = lambda name: measurement(name, v["t"], v["w"])
        out = F.when(rules[0].test(of), rules[0].name)
        for rule in rules[1:]:
            out = out.when(rule.test(of), rule.name)
        return out

    t = F.coalesce(text, F.lit(""))
    return bind(F.struct(t.alias("t"), words_of(t).alias("w")), first)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stutter and n_repeat_words (long) of every document."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = words_of(t)
    inner = docs.select(*keep, t.alias("__gl_text"), w.alias("__gl_words"), measurement("lines", t, w).alias("__gl_lines"))
    of = lambda name: measurement(name, F.col("__gl_text"), F.col("__gl_words")).alias(name)
    lines = F.col("__gl_lines")
    return inner.select(*keep, of("n_words"), of("word_chars"), of("n_symbols"), F.size(lines).cast("long").alias("n_lines"), _doubles(lines).alias("n_dup_lines"), of("n_stutter"), of("n_repeat_words"))


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, int]]:
    """By rule: its price over a sample of about sample_rows rows, and how many of them it rejects."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    t = F.coalesce(F.col("t"), F.lit(""))
    sample = cut(docs.select(F.col(f"`{text}`").alias("t")).sample(share, seed=1).limit(2 * sample_rows).select("t", F.length(t).alias("chars"), F.size(words_of(t)).alias("words")), "rules")
    price = lambda r: F.sum(F.lit(r.per_text) + r.per_char * F.col("chars") + r.per_word * F.col("words"))
    row = sample.agg(*[c for k, r in enumerate(rules) for c in (price(r).alias(f"p{k}"), F.count(rejection([r], F.col("t"))).alias(f"n{k}"))]).collect()[0]
    return {r.name: (row[f"p{k}"] or 0.0, row[f"n{k}"]) for k, r in enumerate(rules)}


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per price on a sample; one that rejects nothing there comes late, equals stay as given."""
    found = estimates(docs, rules, text, sample_rows)
    return sorted(rules, key=lambda r: -(found[r.name][1] + 0.5) / max(found[r.name][0], 1.0))


def first_rejection(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The same cascade over the columns of `measured`."""
    out = F.when(F.expr(rules[0].rejects), rules[0].name)
    for rule in rules[1:]:
        out = out.when(F.expr(rule.rejects), rule.name)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document: `keep`, all measurements, rejected_by (string, null if kept) and kept (boolean)."""
    by = first_rejection(ordered(docs, rules, text))
    return measured(docs, text, keep).withColumn("rejected_by", by).withColumn("kept", F.col("rejected_by").isNull())


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns, whatever their names."""
    return docs.filter(rejection(ordered(docs, rules, text), F.col(f"`{text}`")).isNull())
