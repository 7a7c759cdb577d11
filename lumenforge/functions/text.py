"""Text normalisation of captions, questions and answers as Column expressions.

Python's white space is Unicode's, so patterns carry (?U); lengths and positions are in code points. A
null text gives null.
"""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, let

# --- Fixed values: what they are decides which answers are equal. ---------------------------------------------
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's",
    "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll",
    "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've",
    "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at",
    "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll", "somebodys": "somebody's",
    "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's",
    "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll",
    "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's",
    "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas",
    "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've",
    "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've",
    "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've",
    "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've",
    "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
CLEANED = r'[.!"()*#:;~]'
# ---------------------------------------------------------------------------------------------------------------


#: Any of PUNCTUATION.
ANY_MARK = "[" + "".join("\\" + p for p in PUNCTUATION) + "]"


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def first_words(c: Column | str, n: int) -> Column:
    """The first n pieces between single blanks, joined again; runs of blanks count as empty pieces."""
    return F.array_join(F.slice(F.split(as_column(c), " "), 1, n), " ")


def clean_caption(c: Column | str, max_words: int = 50, prompt: str = "") -> Column:
    """Lower-cased, marks to blanks, white space runs to one blank, trimmed, at most max_words words, after the prompt."""
    t = F.regexp_replace(F.lower(as_column(c)), CLEANED, " ")
    t = F.regexp_replace(t, r"(?U)\s{2,}", " ")
    t = F.trim(F.rtrim(t, F.lit("\n")))
    return F.concat(F.lit(prompt), first_words(t, max_words))


def clean_question(c: Column | str, max_words: int = 50) -> Column:
    """Lower-cased, marks deleted, blanks at the end dropped, at most max_words words."""
    return first_words(F.rtrim(F.regexp_replace(F.lower(as_column(c)), CLEANED, "")), max_words)


def answer_punctuation(c: Column | str) -> Column:
    """Marks of an answer (F03): each is deleted where the original text has it beside a blank or holds digit,comma,digit, and becomes a blank otherwise; then up to 32 full stops that no digit follows go."""

    def body(t: Column) -> Column:
        def marks(s: Column) -> Column:
            out = s["t"]
            for p in PUNCTUATION:
                gone = s["n"] | s["t"].contains(p + " ") | s["t"].contains(" " + p)
                out = F.replace(out, F.lit(p), F.when(gone, F.lit("")).otherwise(F.lit(" ")))
            return out

        # most texts have no mark at all
        return F.when(t.rlike(ANY_MARK), let(F.struct(t.alias("t"), t.rlike(r"(?U)\d,\d").alias("n")), marks)).otherwise(t)

    return F.array_join(F.split(let(as_column(c), body), r"(?U)\.(?!\d)", 33), "")


def answer_words(c: Column | str) -> Column:
    """Number words to digits, articles dropped, contractions restored, words joined by one blank."""
    # a set is asked first: a map is searched from its begin, which is for words that are in it
    look = lambda m, w: F.when(w.isin(list(m)), F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), w)).otherwise(w)
    words = F.filter(F.split(F.lower(as_column(c)), r"(?U)\s+"), lambda w: ~w.isin(["", *ARTICLES]))
    # no number word stands for an article and no contraction is a number word's digit
    return F.array_join(F.transform(words, lambda w: look({**CONTRACTIONS, **NUMBER_WORDS}, w)), " ")


def normalise_answer(c: Column | str) -> Column:
    """An answer as the consensus score compares it: line ends and tabs to blanks, trimmed, F03, F04."""
    return answer_words(answer_punctuation(strip(F.regexp_replace(as_column(c), r"[\n\t]", " "))))


def clean_prediction(c: Column | str) -> Column:
    """A generated answer without commas and markers of padding and end, trimmed, its first line."""
    t = as_column(c)
    for gone in (",", "<pad>", "</s>"):
        t = F.replace(t, F.lit(gone), F.lit(""))
    return F.element_at(F.split(strip(t), "\n"), 1)


def unigram_f1(ref: Column | str, pred: Column | str) -> Column:
    """F value of words by membership, each word as often as it stands (F07); null where a side has no word."""
    words = lambda c: F.filter(F.split(as_column(c), r"(?U)\s+"), lambda w: w != "")

    def score(s: Column) -> Column:
        part = lambda a, b: F.try_divide(F.size(F.filter(b, lambda w: F.array_contains(a, w))).cast("double"), F.size(b))
        p, r = part(s["r"], s["p"]), part(s["p"], s["r"])
        return F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * r * p, r + p))

    return let(F.struct(words(ref).alias("r"), words(pred).alias("p")), score)


def first_match(c: Column | str, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule whose text is contained, case and all."""
    t, out = as_column(c), F
    for needle, label in rules:
        out = out.when(t.contains(needle), label)
    return out.otherwise(otherwise)


PLACE_RULES = [("Where", "Place"), ("How many", "Number"), ("What color", "Color"), ("What is the color", "Color"), ("What shape", "Object nature"), ("What type", "Object nature"), ("What kind", "Object nature"), ("What is", "Object")]
FORM_RULES = [(w, w) for w in ("What", "How", "Can", "Is", "Which")]


def question_place_class(c: Column | str) -> Column:
    """Place, Number, Color, Object nature, Object or Other."""
    return first_match(c, PLACE_RULES, "Other")


def question_form_class(c: Column | str) -> Column:
    """What, How, Can, Is, Which or Other."""
    return first_match(c, FORM_RULES, "Other")


def trim_question(c: Column | str) -> Column:
    """What stands after the last "Question: ", in one line, without an answer made up after it."""
    t = strip(F.replace(F.element_at(F.split(as_column(c), r"\QQuestion: \E"), -1), F.lit("\n"), F.lit(" ")))

    def cut(q: Column) -> Column:
        parts = F.split(q, r"\QAnswer:\E")
        return F.when(~q.contains("Answer:"), q).when(F.get(parts, 0) == "", strip(F.get(parts, 1))).otherwise(strip(F.get(parts, 0)))

    return let(t, cut)


def trim_answer(c: Column | str) -> Column:
    """What stands before the first "Question:", in one line."""
    return strip(F.replace(F.get(F.split(as_column(c), r"\QQuestion:\E"), 0), F.lit("\n"), F.lit(" ")))


def parse_task(c: Column | str) -> Column:
    """The first section's text from two characters after its first colon on; null without a colon."""
    part = F.get(F.split(as_column(c), "\n\n"), 0)
    return let(part, lambda p: F.when(F.locate(":", p) > 0, F.substring(p, F.locate(":", p) + 2, F.length(p))))


def parse_action(c: Column | str) -> Column:
    """The second section's text after its first colon at a line's end; null without one."""
    part = F.get(F.split(as_column(c), "\n\n"), 1)
    return let(part, lambda p: F.when(F.locate(":\n", p) > 0, F.substring(p, F.locate(":\n", p) + 2, F.length(p))))


def swap_left_right(c: Column | str) -> Column:
    """left to right and right to left."""
    t = F.replace(as_column(c), F.lit("left"), F.lit("[TEMP_TOKEN]"))
    return F.replace(F.replace(t, F.lit("right"), F.lit("left")), F.lit("[TEMP_TOKEN]"), F.lit("right"))


def image_id(c: Column | str) -> Column:
    """The id in an image's file name: after the last slash, without characters of ".jpg" at the ends, after the last underscore."""
    name = F.trim(F.element_at(F.split(as_column(c), "/"), -1), F.lit(".jpg"))
    return F.element_at(F.split(name, "_"), -1)


def fusion_prompt(question: Column | str, captions: Column | str) -> Column:
    """question \\n captions with a literal backslash-n between, lower-cased."""
    return F.concat(strip(F.lower(as_column(question))), F.lit(" \\n "), F.lower(as_column(captions)))


def qa_prompt(contexts: Column | str, pairs: Column | str, question: Column | str) -> Column:
    """Contexts, synthetic question-answer pairs and the question as one prompt (F20); pairs is array<struct<question, answer>>."""
    told = F.array_join(F.transform(as_column(pairs), lambda p: F.concat(F.lit("Question:"), p["question"], F.lit("\nAnswer:"), p["answer"], F.lit("\n"))), "")
    return F.concat(F.lit("Contexts:"), F.array_join(as_column(contexts), " . "), F.lit("\n"), told, F.lit("Question:"), as_column(question), F.lit("\nAnswer:"))


def accept_new(captions: Column | str) -> Column:
    """The array's captions that are no part of one accepted before, in order."""
    none = F.array().cast("array<string>")
    return F.aggregate(as_column(captions), none, lambda kept, c: F.when(F.exists(kept, lambda k: k.contains(c)), kept).otherwise(F.concat(kept, F.array(c))))


def clean_text(c: Column | str) -> Column:
    """Entities of mark-up resolved twice, white space to one blank, trimmed, lower-cased (F22); named entities: the five of XML and nbsp."""
    t = as_column(c)
    for _ in range(2):
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            t = F.replace(t, F.lit(name), F.lit(char))
    return F.lower(strip(F.regexp_replace(strip(t), r"(?U)\s+", " ")))


def repair(text: str) -> str:
    """Text that was UTF-8 read as Windows' Western code page, read rightly; all else as it is."""
    if not any(c in text for c in "ÃÂâ"):
        return text
    try:
        return text.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


def clean_any_text(c: Column | str) -> Column:
    """clean_text() with every named and numbered entity and with wrongly read UTF-8 repaired (F22); in Arrow batches, as built-in functions know neither."""
    @F.pandas_udf("string")
    def resolve(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(html.unescape(repair(t))))

    return F.lower(strip(F.regexp_replace(strip(resolve(as_column(c))), r"(?U)\s+", " ")))


def fix_length(ids: Column | str, length: int, start: int, end: int, pad: int = 0) -> Column:
    """start, ids, end, cut to length with end kept last, padded behind."""
    full = F.concat(F.array(F.lit(start)), as_column(ids), F.array(F.lit(end)))
    cut = let(full, lambda x: F.when(F.size(x) > length, F.concat(F.slice(x, 1, length - 1), F.array(F.lit(end)))).otherwise(x))
    return let(cut, lambda x: F.concat(x, F.array_repeat(F.lit(pad), length - F.size(x))))


def replace_in_path(c: Column | str, steps: Mapping[str, str]) -> Column:
    """Path rewriting by literal replacements in order."""
    t = as_column(c)
    for old, new in steps.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def drive_id(c: Column | str) -> Column:
    """The file id of a shared-drive address; null if it is none."""
    found = F.regexp_extract(as_column(c), r"/file/d/([^/]*)", 1)
    return F.when(as_column(c).rlike(r"(drive|docs)[.]google[.]com") & (found != ""), found)


def strip_echo(decoded: Column | str, prompt: Column | str) -> Column:
    """Decoded text without its prompt's echo, markers of the end counted."""
    d, p = as_column(decoded), as_column(prompt)
    marks = F.regexp_count(d, F.lit("</s>"))
    # a negative count of characters to drop takes from the end, as a slice does
    skip = F.length(p) + 1 - 3 * marks
    start = F.when(skip >= 0, skip).otherwise(F.greatest(F.lit(0), F.length(d) + skip))
    return strip(F.substring(d, start + 1, F.length(d)))


def natural_prefix(c: Column | str) -> Column:
    """A name's part before its digits."""
    return F.regexp_extract(as_column(c), r"^(\D*)", 1)


def natural_number(c: Column | str) -> Column:
    """A name's first digits as a number."""
    return F.regexp_extract(as_column(c), r"(\d+)", 1).try_cast("bigint")


def merge_maps(old: Column | str, new: Column | str) -> Column:
    """Settings by key, the later map's where it has one (F32)."""
    return F.map_zip_with(as_column(old), as_column(new), lambda _, a, b: F.coalesce(b, a))
