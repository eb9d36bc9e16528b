"""Scalar text functions as Spark expressions: normalisation, sentences, ratios, answer metrics.

All stay inside the JVM. Offsets and lengths are code points. White space is Unicode white space, named
by an explicit class: it is matched much faster than the property, and trimming needs no pattern at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.config import ABSTAIN_MARKERS

# ASCII punctuation, section titles without content, and the fallback tokenizer.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
DROPPED_SECTIONS = ("references", "external links", "see also", "further reading", "notes", "bibliography", "sources", "citations", "navigation", "notes and references")
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\t-\r \p{L}\p{N}]+"


# Unicode white space, as characters and as the inside of a class.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def once(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(x, F.lit(SPACES))


def squeeze(x: Column) -> Column:
    """Each run of white space to one space."""
    return F.regexp_replace(x, f"[{SPACE}]+", " ")


def normalize_title(x: Column) -> Column:
    return F.lower(squeeze(F.replace(strip(x), F.lit("_"), F.lit(" "))))


def strip_citations(x: Column) -> Column:
    return F.regexp_replace(x, r"\[(?:\d+|(?i:citation needed))\]", "")


def normalize_whitespace(x: Column) -> Column:
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


#: Between paragraphs.
BREAK = f"\\n[{SPACE}]*\\n"


def split_paragraphs(x: Column) -> Column:
    parts = F.transform(F.split(strip(x), BREAK), strip)
    return F.filter(parts, lambda p: p != "")


def split_sentences(x: Column) -> Column:
    """Cut after each of ``. ! ?`` once a sentence has two characters; the rest is the last one."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s).[^.!?]*[.!?]|.[^.!?]*$"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(x: Column) -> Column:
    """Split at white space; no empty words."""
    return F.filter(F.split(strip(x), f"[{SPACE}]+"), lambda w: w != "")


def char_ngrams(x: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the lower-cased, squeezed text; a shorter text is its own gram."""
    none = F.array().cast("array<string>")

    def grams(t: Column) -> Column:
        every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))
        return F.when(F.length(t) == 0, none).when(F.length(t) < n, F.array(t)).otherwise(every)

    return once(strip(squeeze(F.lower(x))), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 1 if both are empty, 0 if one is."""
    inter = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - inter
    return F.when(either == 0, F.lit(1.0)).otherwise(inter / either)


def gram_similarity(a: Column, b: Column, n: int = 5) -> Column:
    """Jaccard similarity of the character n-grams of two texts."""
    return once(F.struct(char_ngrams(a, n).alias("a"), char_ngrams(b, n).alias("b")), lambda x: jaccard(x["a"], x["b"]))


def token_count(x: Column) -> Column:
    """Tokens by the fallback tokenizer: letters, up to three digits, or other characters in a row."""
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0)))


def should_drop_section(title: Column) -> Column:
    return F.lower(strip(title)).isin(*DROPPED_SECTIONS)


def prose_ratio(x: Column) -> Column:
    """Share of characters, over stripped non-blank lines, in lines that look like prose."""
    start = F.struct(F.lit(0).alias("prose"), F.lit(0).alias("every"))

    def step(acc: Column, line: Column) -> Column:
        n = F.length(line)
        other = line.rlike(r"^[|!*#{]|(?U)^[\d\W]*$")
        return F.struct((acc["prose"] + F.when(other, 0).otherwise(n)).alias("prose"), (acc["every"] + n).alias("every"))

    lines = F.transform(F.split(F.coalesce(x, F.lit("")), r"\R"), strip)
    return F.aggregate(lines, start, step, lambda acc: F.when(acc["every"] == 0, F.lit(0.0)).otherwise(acc["prose"] / acc["every"]))


def paragraph_repeat_ratio(x: Column) -> Column:
    """Share of paragraphs that repeat an earlier one, ignoring case and white space."""
    keys = F.transform(split_paragraphs(F.coalesce(x, F.lit(""))), lambda p: strip(squeeze(F.lower(p))))
    return once(keys, lambda k: F.when(F.size(k) < 2, F.lit(0.0)).otherwise((F.size(k) - F.size(F.array_distinct(k))) / F.size(k)))


#: An article as a whole word; the first letter is tried before the costly boundary.
ARTICLE = r"(?U)(?:a(?<=\ba)n?|t(?<=\bt)he)\b"


def normalize_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; null becomes empty."""
    t = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")
    return F.trim(squeeze(F.regexp_replace(t, ARTICLE, " ")), F.lit(" "))


def answer_tokens(x: Column) -> Column:
    return F.filter(F.split(normalize_answer(x), " "), lambda w: w != "")


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def bag_overlap(p: Column, g: Column) -> Column:
    """Tokens that two bags share, each as often as both hold it: one fold over the sorted tokens of both,
    in which those of ``p`` come first and each of ``g`` uses up one of them."""
    tagged = lambda bag, side: F.transform(bag, lambda t: F.struct(t.alias("t"), F.lit(side).alias("s")))
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("same"))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(acc["t"] == x["t"], acc["left"]).otherwise(0)
        used = (x["s"] == 1) & (left > 0)
        return F.struct(x["t"].alias("t"), F.when(x["s"] == 0, left + 1).when(used, left - 1).otherwise(left).alias("left"), (acc["same"] + used.cast("int")).alias("same"))

    return F.aggregate(F.array_sort(F.concat(tagged(p, 0), tagged(g, 1))), start, step, lambda acc: acc["same"])


def token_f1_of(p: Column, g: Column) -> Column:
    """F1 of two token bags. Give columns, not expressions: each is used several times."""
    same = bag_overlap(p, g)
    precision, recall = same / F.size(p), same / F.size(g)
    score = 2 * precision * recall / (precision + recall)
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(g) == 0) | (same == 0), F.lit(0.0)).otherwise(score)


def token_f1(prediction: Column, gold: Column) -> Column:
    return token_f1_of(answer_tokens(prediction), answer_tokens(gold))


def contains_answer(text: Column, answer: Column) -> Column:
    """Normalised containment; an answer that normalises to nothing is always contained."""
    return F.contains(normalize_answer(text), normalize_answer(answer))


def token_set(x: Column) -> Column:
    """Distinct normalised tokens of three characters or more."""
    return F.array_distinct(F.filter(answer_tokens(x), lambda w: F.length(w) > 2))


def lexical_overlap(query: Column, text: Column) -> Column:
    q = token_set(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, token_set(text))) / F.size(q))


def is_abstention(prediction: Column, markers: tuple[str, ...] = ABSTAIN_MARKERS) -> Column:
    p = F.lower(strip(F.coalesce(prediction, F.lit(""))))
    return reduce(lambda a, m: a | F.contains(p, F.lit(m)), markers, p == "")


def normalize_model_id(x: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.when(t == "", "model").otherwise(t)


def candidate_id(chunk: Column, question: Column) -> Column:
    return F.concat(F.lit("cand_"), F.substring(F.sha1(F.concat(chunk, F.lit("||"), question).cast("binary")), 1, 12))


def chunk_id(page: Column, revision: Column, paragraph: Column, chunk: Column) -> Column:
    return F.concat_ws("_", *(c.cast("string") for c in (page, revision, paragraph, chunk)))


def matches_support(sentence: Column, support: Column) -> Column:
    """Normalised containment in either direction; false if either is empty."""
    s, t = normalize_answer(sentence), normalize_answer(support)
    return (s != "") & (t != "") & (F.contains(s, t) | F.contains(t, s))


def halves(x: Column) -> Column:
    """struct(a, b): the words cut in the middle, or the characters if there is but one word."""
    w = words(x)
    middle = F.floor(F.size(w) / 2).cast("int")
    joined = lambda a: F.array_join(a, " ")
    chars = F.greatest(F.lit(1), F.floor(F.length(x) / 2).cast("int"))
    return F.when(F.size(w) < 2, F.struct(F.substring(x, F.lit(1), chars).alias("a"), F.substr(x, chars + 1).alias("b"))).otherwise(
        F.struct(joined(F.slice(w, F.lit(1), middle)).alias("a"), joined(F.slice(w, middle + 1, F.size(w))).alias("b"))
    )


# Reasons by the validation layer they belong to; anything else is a rule check.
REASON_COMPONENTS = {
    "judge_rejected": "llm_judge",
    "baseline_incorrect": "baseline_test",
    "below_quality_threshold": "quality_threshold",
    "duplicate_question": "deduplication",
    "duplicate_supporting_fact": "deduplication",
    "near_duplicate_question": "deduplication",
}
COMPONENTS = ("rule_checks", "llm_judge", "baseline_test", "quality_threshold", "deduplication")


def reason_component(reason: Column) -> Column:
    out = F.when((reason == "") | reason.isNull(), F.lit(None))
    for name, component in REASON_COMPONENTS.items():
        out = out.when(reason == name, component)
    return out.otherwise("rule_checks")


def keyed(*parts) -> Column:
    """The md5 of the parts joined by colons: the order of every keyed sample."""
    return F.md5(F.concat_ws(":", *(lit(p).cast("string") for p in parts)).cast("binary"))


def format_percent(mean: Column, std: Column) -> Column:
    """``mean ± std`` in per cent with one digit; ``n/a`` without a mean."""
    return F.when(mean.isNull(), "n/a").otherwise(F.format_string("%.1f%% ± %.1f%%", mean * 100, F.coalesce(std, F.lit(0.0)) * 100))


def format_number(mean: Column, std: Column) -> Column:
    return F.when(mean.isNull(), "n/a").otherwise(F.format_string("%.1f ± %.1f", mean, F.coalesce(std, F.lit(0.0))))


# Stand-in answers by type.
ALTERNATES = {
    "person": ("John Smith", "Jane Doe", "Alex Rivera", "Morgan Lee"),
    "organization": ("Microsoft", "IBM", "Amazon", "OpenAI", "Meta"),
    "location": ("Paris", "Tokyo", "Cairo", "Toronto", "Sydney"),
    "date": ("January 1, 1999", "March 15, 2005", "July 4, 2010"),
    "numeric": ("42", "100", "7", "3.14"),
    "other": ("Option A", "Option B", "an alternative account"),
}


def _general(x: Column) -> Column:
    """A number of one or more as C's %g prints it: six significant digits, no trailing zeros, an exponent
    from a million on."""
    fixed = F.round(x, 0)
    for places in range(1, 6):
        fixed = F.when(x < 10 ** (6 - places), F.round(x, places)).otherwise(fixed)
    large = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    return F.when(x >= 999_999.5, large).otherwise(F.regexp_replace(fixed.cast("string"), r"\.0$", ""))


def alternate_answer(gold: Column, answer_type: Column, *key) -> Column:
    """Another answer: the year three earlier, the first number plus one, else a keyed pick by type."""
    parts = lambda found: tuple(F.regexp_extract(gold, rf"(?sU)^(.*?)\b({found})\b(.*)$", k) for k in (1, 2, 3))
    before, year, after = parts(r"1[0-9]{3}|20[0-9]{2}")
    head, number, tail = parts(r"[0-9]+(?:\.[0-9]+)?")
    plus = F.when(F.contains(number, F.lit(".")), _general(number.cast("double") + 1)).otherwise((number.cast("decimal(38,0)") + 1).cast("string"))
    pool = F.lit(None)
    for name, values in ALTERNATES.items():
        pool = F.when(answer_type == name, F.array(*map(F.lit, values))).otherwise(pool)
    pool = F.coalesce(pool, F.array(*map(F.lit, ALTERNATES["other"])))
    open_ = F.filter(pool, lambda a: normalize_answer(a) != normalize_answer(gold))
    at = F.pmod(F.conv(F.substring(keyed(*key), 1, 8), 16, 10).cast("long"), F.size(open_).cast("long")).cast("int")
    dated = (answer_type == "date") & (year != "")
    counted = answer_type.isin("numeric", "other") & (number != "") & plus.isNotNull()
    return F.when(dated, F.concat(before, (year.cast("int") - 3).cast("string"), after)).when(counted, F.concat(head, plus, tail)).otherwise(F.get(open_, at))


def conflict_passage(support: Column, gold: Column, other: Column) -> Column:
    """The support with ``other`` for the first ``gold`` (any case, if need be), else a sentence saying so."""
    exact, folded = F.instr(support, gold), F.instr(F.lower(support), F.lower(gold))
    at = F.when(exact > 0, exact).otherwise(folded)
    swapped = F.concat(F.substring(support, F.lit(1), at - 1), other, F.substr(support, at + F.length(gold)))
    told = F.concat(F.lit("Some sources incorrectly claim the answer is "), gold, F.lit(". In fact, it is "), other, F.lit("."))
    return F.when((gold != "") & (at > 0), swapped).otherwise(told)
