"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions import words as fw


def key(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")


#: Letters whose capital is more than one, and those of them that have a capital of one letter too.
_SPREAD = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1)
_TITLE = {c: c.title() for c in _SPREAD if len(c.title()) == 1 and c.title() != c} | {"\u00df": "\u1e9e"}


def upper(text: Column) -> Column:
    """Capitals letter by letter, so that the text keeps its length: other than Spark's `upper`, which writes SS for a sharp s, it writes one capital sharp s."""
    alone = f"[{_SPREAD}]"
    parts = F.split(text, f"(?={alone})|(?<={alone})")
    whole = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{alone}$"), F.translate(x, "".join(_TITLE), "".join(_TITLE.values()))).otherwise(F.upper(x))), "")
    return F.when(text.rlike(alone), whole).otherwise(F.upper(text))


def diff_key(token: Column) -> Column:
    """As :func:`key`, but a token without letters and digits is its own key."""
    return F.coalesce(F.nullif(key(token), F.lit("")), token)


def diff_keys(text: Column) -> Column:
    """:func:`diff_key` of each word of a text whose words are parted by single spaces."""
    keys = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd} ]", ""), " ")
    return F.array_join(F.zip_with(keys, F.split(text, " "), lambda k, w: F.coalesce(F.nullif(k, F.lit("")), w)), " ")


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def clean_spaces(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s{2,}", " ")


def join_surfaces(words: Column) -> Column:
    """Words joined by spaces; a part led by an apostrophe is glued to a letter before it."""
    tidy = F.filter(F.transform(words, lambda w: F.regexp_replace(F.trim(F.regexp_replace(w, r"\s+", " ")), "^ | $", "")), lambda w: w != "")
    return F.regexp_replace(F.array_join(tidy, " "), r"(?<=\p{L}) (?=['’ʼ‘]\S)", "")


def trim_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, r"^\p{P}+|\p{P}+$", "")


def is_acronym(word: Column) -> Column:
    """3 to 6 capitals or digits, at least one letter."""
    return word.rlike(r"^[\p{Lu}\p{Nd}]{3,6}$") & word.rlike(r"\p{L}")


def looks_like_name(word: Column) -> Column:
    """A capital first, a small letter or digit later."""
    return word.rlike(r"^\p{Lu}.*[\p{Ll}\p{Nd}]")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?\n]"), lambda x: x != "")


def display_speaker(name: Column, speaker: Column) -> Column:
    return F.coalesce(name, F.replace(speaker, F.lit("SPEAKER_"), F.lit("Speaker ")))


def csv_list(text: Column) -> Column:
    """Parts between commas; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def escape_like(text: Column) -> Column:
    """Escape a LIKE pattern's signs: the escape sign itself first."""
    out = text
    for sign in ("\\", "%", "_"):
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return out


def duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss, cut to whole seconds."""
    s = seconds.cast("long")
    long = F.format_string("%d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60)
    return F.when(s >= 3600, long).otherwise(F.format_string("%d:%02d", (s / 60).cast("long"), s % 60))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, cut to milliseconds, never below zero."""
    ms = F.greatest((seconds * 1000).cast("long"), F.lit(0).cast("long"))
    part = lambda step, mod: ((ms / step).cast("long")) % mod
    return F.format_string("%02d:%02d:%02d,%03d", (ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


#: Fixed value: words in front of an answer that are no part of it.
PREAMBLE = r"(?i)^(?:sure[!,. ]*\s*|okay[!,. ]*\s*|of course[!,. ]*\s*|here(?:'s| is| are)[^\n:]*[:.\-—]\s*|the (?:transcription|translation)[^\n:]*[:.\-—]\s*|transcription[:.\-—]\s*|translation[:.\-—]\s*)"
#: Prompt phrases that a model may echo, removed in this order.
LEAKS = [
    r"(?i)=+\s*CONTEXT[\s\S]*?=+\s*END CONTEXT\s*=+\s*",
    r"(?i)=+\s*END CONTEXT\s*=+\s*",
    r"(?i)=+\s*CONTEXT\s*\(\s*DO NOT (?:TRANSCRIBE|REPEAT)[^=\n]*?\)?\s*=+\s*",
    r"(?i)\[continuing as Speaker\s+\d+\s*:[^\]]*\]\s*",
    r"(?i)continuity\s+hint[^\n.]*?the previous chunk[^\n.]*?(?:[.\n]|$)\s*",
    r"(?i)the previous chunk ended with[^\n.]*?(?:[.\n]|$)\s*",
    r"(?i)continue naturally from where (?:it stopped|the previous chunk[^\n.]*)\.?\s*",
    r"(?i)(?:transcribe|translate) the following speech segment[^.\n]*?(?:[.\n]|$)\s*",
    r"(?i)only output the transcription[^.\n]*?(?:[.\n]|$)\s*",
    r"(?i)when transcribing numbers[^.\n]*?(?:[.\n]|$)\s*",
    r"(?i)the speech is in [^.\n]*?detect which and transcribe[^.\n]*?(?:[.\n]|$)\s*",
    r"(?i)Vocabulary \(spell exactly[^:]*\):[^\n]*?(?:[.\n]|$)\s*",
    r"(?i)Remove filler words:[^\n]*?(?:[.\n]|$)\s*",
    r"(?i)Verbatim mode:[^\n]*?(?:[.\n]|$)\s*",
    r"(?i)Tone:\s*(?:formal|casual|enthusiastic|technical|neutral)\b[^\n]*?(?:[.\n]|$)\s*",
    r"(?m)^\s*Additional instructions:\s*$",
    r"(?im)^\s*Speaker\s+\d+\s*:\s*$",
]


def strip_preamble(text: Column) -> Column:
    """Without one pair of quotes around it, and without a leading preamble."""
    inner = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    bare = F.regexp_extract(inner, r"(?s)^(?:\"(.+)\"|“(.+)”|‘(.+)’|'(.+)')$", 0)
    unquoted = F.when((bare != "") & (F.length(inner) > 2), F.substring(inner, F.lit(2), F.length(inner) - 2)).otherwise(inner)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(unquoted, r"^\s+|\s+$", ""), PREAMBLE, ""), r"^\s+|\s+$", "")


def strip_leaks(text: Column) -> Column:
    for pattern in LEAKS:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def scrub_vocabulary_echo(text: Column, vocabulary: list[str]) -> Column:
    """Empty if a short text is nothing but three or more words of the vocabulary."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?i)\bSpeaker\s+\d+\s*:\s*", ""), r"^\s+|\s+$", "")
    words = F.filter(F.transform(F.split(body, r"[\s,]+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", ""))), lambda w: w != "")
    known = [w.strip().lower() for w in vocabulary if w.strip()]
    echo = (F.length(F.trim(text)) <= 200) & (F.size(words) >= 3) & F.forall(words, lambda w: w.isin(known))
    return F.when(echo, "").otherwise(text) if known else text


#: Phrases of a refusal.
REFUSALS = ["i cannot transcribe", "i am unable to", "as an ai", "sorry, i", "i can't help with"]
#: A phrase of two to five words four times in a row, words separated by single spaces.
LOOP = r"(?:^| )(\S+(?: \S+){1,4}?)(?: \1){3}(?= |$)"
LOW_AT = 0.5


def suspicion(text: Column, seconds: Column) -> Column:
    """How much a chunk's text looks like a failure, 0 to 1; `LOW_AT` and above is low confidence."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    n, flat = F.length(body), F.regexp_replace(body, r"\s+", " ")
    short = F.when((seconds > 5) & (n < 12), 0.6).when((seconds > 15) & (n < 60), 0.3).otherwise(0.0)
    loop = F.when(flat.rlike(LOOP), 0.7).otherwise(0.0)
    refusal = F.when(F.lower(body).rlike("|".join(REFUSALS)), 0.8).otherwise(0.0)
    open_end = F.when((n > 30) & body.rlike(r"\p{L}$"), 0.15).otherwise(0.0)
    return F.least(short + loop + refusal + open_end, F.lit(1.0))


def pick_sane(a: Column, b: Column, seconds: Column) -> Column:
    """The other text where exactly one is of low confidence, else null."""
    low_a, low_b = suspicion(a, seconds) >= LOW_AT, suspicion(b, seconds) >= LOW_AT
    return F.when(low_a & ~low_b, b).when(low_b & ~low_a, a)


def dice(a: Column, b: Column) -> Column:
    """Twice the words in common over all words, counting repeats; 0 if either has none. The time is linear; see `names.agreement` for texts too long for a row."""

    def share(x: list[str], y: list[str]) -> float:
        return 2.0 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) if len(x) and len(y) else 0.0

    return fw.arrow(share, "double")(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; 1 for a vector of no length."""
    sum_of = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    norm = F.sqrt(sum_of(F.transform(a, lambda x: x.cast("double") * x))) * F.sqrt(sum_of(F.transform(b, lambda x: x.cast("double") * x)))
    return F.when(norm <= 1e-12, 1.0).otherwise(1 - F.least(F.greatest(dot / norm, F.lit(-1.0)), F.lit(1.0)))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def top_gram_share(text: Column, n: int = 8, tail: int = 200) -> Column:
    """How often the most frequent run of `n` characters stands in the last `tail`; blank ones don't count."""
    end = F.right(text, F.lit(tail))
    grams = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(end) - n + 1, F.lit(1))), lambda k: F.substring(end, k, F.lit(n))), lambda g: (F.length(F.trim(g)) >= 4) & (F.length(g) == n))
    # one pass over the sorted runs, as a lambda that reads the array would work it out again for each of them
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def count(state: Column, g: Column) -> Column:
        n = F.when(g == state["last"], state["n"] + 1).otherwise(1)
        return F.struct(g.alias("last"), n.alias("n"), F.greatest(state["best"], n).alias("best"))

    return F.aggregate(F.array_sort(grams), start, count, lambda state: state["best"])


#: Schemas of a model's replies, as it is asked for them and as they are read.
CATEGORY_REPLY, CHOICES_REPLY, MERGE_REPLY = "category string", "choices array<int>", "merge array<array<int>>"
#: Keys need no quotes and texts may have single ones; a text value without any is not read.
LENIENT = {"mode": "PERMISSIVE", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}
CATEGORY_IDS = ["meeting", "interview", "note", "idea"]


def parse_category(reply: Column) -> Column:
    """meeting, interview, note or idea of a JSON reply, else null."""
    found = F.lower(F.from_json(reply, CATEGORY_REPLY, LENIENT)["category"])
    return F.when(found.isin(CATEGORY_IDS), found)


def parse_choices(reply: Column, n: Column) -> Column:
    """`n` choices of a JSON reply, 0 for missing ones, kept to 0 and 1; null if malformed or empty though some are asked."""
    got = F.from_json(reply, CHOICES_REPLY, LENIENT)["choices"]
    filled = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(F.least(F.greatest(F.get(got, k), F.lit(0)), F.lit(1)), F.lit(0)))
    return F.when(got.isNull() | ((F.size(got) == 0) & (n > 0)), None).when(n <= 0, F.array().cast("array<int>")).otherwise(filled)


def parse_merges(reply: Column, ids: Column) -> Column:
    """Pairs of different known ids in a JSON reply; none if malformed."""
    got = F.coalesce(F.from_json(reply, MERGE_REPLY, LENIENT)["merge"], F.array().cast("array<array<int>>"))
    return F.filter(got, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != F.get(p, F.lit(1))) & F.array_contains(ids, F.get(p, F.lit(0))) & F.array_contains(ids, F.get(p, F.lit(1))))


#: A marker that opens a speaker's line.
MARKER = r"(?i)\bSpeaker\s+\d+\s*:"


def is_runaway(text: Column, short: int = 80, long: int = 200, markers: int = 3, gram: int = 8) -> Column:
    """Whether a text ends in a loop: speaker markers with empty or equal bodies, or one run of characters over and over."""
    end = F.right(text, F.lit(short))
    bodies = F.transform(F.slice(F.split(end, MARKER), 2, short), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    same = F.filter(bodies, lambda x, i: (x == "") | ((i > 0) & (x == F.get(bodies, i - 1))))
    marked = (F.length(text) >= short) & (F.size(bodies) >= markers) & (F.size(same) >= markers - 1)
    return marked | ((F.length(text) >= long) & (top_gram_share(text, gram, long) * gram > long / 2))


def is_same_day(at: Column, now: Column) -> Column:
    """Whether two moments are on one day in the session's time zone."""
    return F.to_date(at) == F.to_date(now)
