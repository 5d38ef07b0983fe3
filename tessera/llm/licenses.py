"""Licence scan by ordered signature rules; DataFrame functions only.

A text's words, after A-Z are lower-cased, are runs of digits, a-z and everything beyond ASCII. One
pass splits the text and intersects its words with the gate words of the rules. Only the rules
whose gates all open run, on the words joined by blanks; each match becomes an interval of words.
Of two intervals one of which contains the other the longer stays, of equal ones that of higher
priority (then the lesser label), so "creative commons attribution" silences "creative commons". Of
what is left, from left to right, the one of higher priority stands where two cross, the earlier at
equal priority. Detections are sorted and swept once. The base phrases are counted apart and always
stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held, sweep
from .license_rules import RULES

BASE = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))
_GATES = sorted({w for _, _, gates, _ in RULES for g in gates for w in g} | {words[-2] for _, words in BASE})
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The Kelvin sign, the only code point outside ASCII that lower() maps to one ASCII letter.
_KELVIN = "K"
DETECTIONS = "array<struct<start:int,stop:int,label:string,priority:int>>"


def split_words(text: F.Column) -> F.Column:
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("é")))
    return F.array_remove(F.split(plain, _NOT_WORD), "")


def _starts(words: F.Column, phrase: tuple[str, ...]) -> F.Column:
    """Word numbers at which the phrase's words stand one after another."""
    last = F.size(words) - len(phrase)

    def here(i):
        found = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            found = found & (F.get(words, i + k) == w)
        return found

    places = F.filter(F.sequence(F.lit(0), last), here)
    return F.when((last >= 0) & F.array_contains(words, phrase[-2]), places).otherwise(F.array().cast("array<int>"))


def _spaces(s: F.Column) -> F.Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))


def _places(said: F.Column, rule: F.Column) -> F.Column:
    """Intervals of words (from, to) that the rule's regex matches in the blank-joined words. Each
    match starts where the last one ended (\\G), so a text is passed once."""
    regex = F.concat(F.lit(r"(?s)\G(.*?)(?<![^ ])("), rule["regex"], F.lit(")(?![^ ])"))
    pairs = F.arrays_zip(F.regexp_extract_all(said, regex, F.lit(1)).alias("b"), F.regexp_extract_all(said, regex, F.lit(2)).alias("h"))

    def step(at, p):
        start = at + _spaces(p["b"])
        stop = start + _spaces(p["h"])
        one = F.struct(start.alias("start"), (stop + 1).alias("stop"), rule["label"].alias("label"), rule["priority"].alias("priority"))
        return stop, F.array(one)

    return sweep(pairs, F.lit(0), step, DETECTIONS)["all"]


def _standing(found: F.Column) -> F.Column:
    """The detections that stand, by start."""
    keyed = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), (-x["priority"]).alias("low"), x["label"].alias("label"))))
    ordered = F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), x["label"].alias("label"), (-x["low"]).alias("priority")))
    one = DETECTIONS[len("array<") : -1]
    none = F.array().cast(DETECTIONS)

    def step(state, x):
        # Whoever contains x, or equals and outranks it, came before it.
        held = state["reach"] >= x["stop"]
        last = state["last"]
        apart = last.isNull() | (last["stop"] <= x["start"])
        takes = ~held & (apart | (x["priority"] > last["priority"]))
        new = F.struct(F.greatest(state["reach"], x["stop"]).alias("reach"), F.when(takes, x).otherwise(last).alias("last"))
        return new, F.when(takes & apart & last.isNotNull(), F.array(last)).otherwise(none)

    zero = F.struct(F.lit(-1).alias("reach"), F.lit(None).cast(one).alias("last"))
    return held(sweep(ordered, zero, step, DETECTIONS), lambda s: F.when(s["state"]["last"].isNull(), none).otherwise(F.concat(s["all"], F.array(s["state"]["last"]))))


def _bound(df: DataFrame, **columns: F.Column) -> DataFrame:
    """df with columns that later expressions find evaluated: a projection would be merged into
    them, and into each step of their lambdas; a generator of one row is not."""
    for name, c in columns.items():
        df = df.withColumn(name, F.explode(F.array(c)))
    return df


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, base (array of word numbers for each base phrase) and detections
    (DETECTIONS that stand, by start). Null and empty texts have none. Other columns pass through;
    ones of these three names are replaced. No shuffle."""
    keep = [f"`{c}`" for c in df.columns if c not in ("n_words", "base", "detections")]
    words = _bound(df, __words=split_words(F.col(f"`{text}`")))
    words = _bound(words, __gates=F.array_intersect(F.array(*map(F.lit, _GATES)), "__words"))
    words = _bound(words, __said=F.when(F.size("__gates") > 0, F.array_join("__words", " ")))
    table = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(p).alias("priority"), F.array(*[F.array(*map(F.lit, x)) for x in g]).alias("gates"), F.lit(r).alias("regex")) for a, p, g, r in RULES])
    active = F.filter(table, lambda r: F.exists(r["gates"][0], lambda w: F.array_contains("__gates", w)) & F.forall(r["gates"], lambda g: F.arrays_overlap(g, "__gates")))
    none = F.array().cast(DETECTIONS)
    found = F.when(F.col("__said").isNotNull(), F.flatten(F.transform(active, lambda r: _places(F.col("__said"), r)))).otherwise(none)
    words = _bound(words, __found=found)
    base = F.struct(*[_starts(F.col("__words"), phrase).alias(label) for label, phrase in BASE])
    return words.select(*keep, F.size("__words").cast("long").alias("n_words"), base.alias("base"), _standing(F.col("__found")).alias("detections"))


def report(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: word count, base phrases (number, first and last start, labels), all
    labels, and a score: the highest priority found, of 100 (a base phrase counts 50), 0 without."""
    s = scan(df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    s = _bound(s.select("doc_id", "n_words", F.struct("base", "detections").alias("r")), __r=F.col("r"))
    s = s.select("doc_id", "n_words", F.col("__r.base").alias("base"), F.col("__r.detections").alias("detections"))
    all_starts = F.concat(*[F.col("base")[label] for label, _ in BASE])
    base_labels = F.array_sort(F.filter(F.array(*[F.when(F.size(F.col("base")[label]) > 0, F.lit(label)) for label, _ in BASE]), lambda x: x.isNotNull()))
    found = F.transform("detections", lambda d: d["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)), F.when(F.size(all_starts) > 0, 50).otherwise(0))
    return s.select(
        "doc_id",
        "n_words",
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, found))), ",").alias("labels"),
        (best / F.lit(100.0)).alias("score"),
    )
