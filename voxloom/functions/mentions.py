"""Names and speaker markers in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions import text as ft

#: Ordinary words that recognizers capitalise.
STOP = [
    "i", "im", "ive", "id", "ill", "ok", "okay", "yes", "no", "yeah", "the", "a", "an", "and", "but", "so", "or", "if", "then", "when", "what",
    "why", "how", "who", "where", "this", "that", "these", "those", "it", "its", "we", "you", "he", "she", "they", "them", "our", "your", "my",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december", "speaker", "hello", "hi", "hey", "thanks", "thank", "bye", "good", "morning",
    "afternoon", "evening", "today", "tomorrow", "yesterday", "english", "dutch", "ukrainian", "german", "french", "spanish", "europe", "european",
    "ja", "nee", "de", "het", "een", "en", "maar", "dus", "ik", "je", "we", "wij", "zij", "так", "ні", "і", "а", "але", "я", "ми", "ви", "вони",
    "це", "що", "як", "uh", "um", "hmm", "mhm", "mmhmm", "oops", "however", "anyway", "right", "well", "тобто", "дякую", "добре", "навірно",
    "напевно", "угу", "ага", "гаразд", "ну", "привіт", "зрозуміло", "будь", "ласка", "давай", "давайте", "тепер", "oké", "hoor", "nou", "eigenlijk",
    "gewoon", "dankjewel", "bedankt", "prima",
]
#: Words that open sentences and are no part of a name that follows.
OPENERS = [
    "then", "ask", "so", "and", "but", "also", "now", "well", "okay", "ok", "please", "let", "maybe", "actually", "yes", "no", "just", "send",
    "call", "tell", "check", "make", "get", "put", "look", "see", "thanks", "thank", "hi", "hello", "dear", "hey", "great", "good", "sure", "right",
    "wait", "sorry", "today", "tomorrow", "yesterday", "after", "before", "during", "since", "with", "without", "for", "from", "to", "in", "on",
    "at", "by", "of", "the", "a", "an", "this", "that", "these", "those", "our", "your", "my", "his", "her", "their", "its", "we", "you", "they",
    "he", "she", "it", "i", "if", "when", "while", "because", "about", "over", "under", "into", "onto", "next", "last", "first", "second",
    "meanwhile", "however", "still", "yet", "even", "only", "later", "earlier", "here", "there", "dan", "dus", "maar", "en", "ook", "nu", "oké",
    "ja", "nee", "vraag", "bel", "stuur", "тоді", "також", "але", "і", "зараз", "так", "ні", "потім", "спитай", "надішли",
]
#: Words after "I'm" and its like that are no names.
NOT_NAMES = [
    "tired", "just", "sorry", "good", "fine", "okay", "ok", "here", "sure", "glad", "happy", "going", "not", "so", "very", "really", "also", "still",
    "now", "well", "done", "ready", "back", "afraid", "there", "guys", "everyone", "everybody", "all", "team", "folks", "my", "your", "the", "a",
    "an", "welcome", "متأكد", "هنا", "جاهز", "آسف", "بخير", "سعيد", "moe", "blij", "niet", "ook", "hier", "klaar", "zeker", "рада", "радий", "тут",
    "готовий",
]


def _one_of(word: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), word)


def name_candidates(text: Column) -> Column:
    """Array of (cand, initial): names and runs of names, and whether a candidate is only its sentence's first word.

    In each sentence all that is no name becomes a line break, which also ends an opening word; what is left between breaks are the
    runs. An acronym is a name wherever it stands.
    """
    like_name = lambda w: ft.is_acronym(w) | ft.looks_like_name(w)
    marked = lambda w, i: F.when(~like_name(w), "\n").when((i == 0) & ~ft.is_acronym(w) & _one_of(F.lower(w), OPENERS), F.concat(w, F.lit("\n"))).otherwise(w)

    def of_sentence(sentence: Column) -> Column:
        words = F.filter(F.transform(F.split(sentence, " "), ft.trim_punctuation), lambda w: w != "")
        runs = F.split(F.concat_ws(" ", F.transform(words, marked)), " *\n *")
        # the first run is empty unless it begins with the sentence
        return F.filter(F.transform(runs, lambda r, k: F.struct(r.alias("cand"), ((k == 0) & ~r.contains(" ") & ~ft.is_acronym(r)).alias("initial"))), lambda c: c["cand"] != "")

    return F.flatten(F.transform(F.split(text, r"[.!?\n]"), of_sentence))


def is_name(candidate: Column) -> Column:
    """Not short, ordinary, contracted, too long or repetitive."""
    parts, whole = F.transform(F.split(candidate, " "), ft.key), ft.key(candidate)
    n = F.size(parts)
    stop = F.array(*map(F.lit, STOP))
    repeats = F.exists(F.zip_with(F.slice(parts, F.lit(1), n - 1), F.slice(parts, F.lit(2), n - 1), lambda a, b: a.startswith(b) | b.startswith(a)), lambda x: x)
    return (F.length(whole) >= 3) & ~F.array_contains(stop, whole) & ~candidate.rlike("['’]") & (n <= 3) & ~F.arrays_overlap(parts, stop) & ~repeats


_CAPITAL = r"(\p{Lu}[\p{L}'’-]+)"
#: Self-introductions in English, Ukrainian, Dutch and Arabic.
INTRODUCTIONS = [
    rf"(?iu:\bmy name is)\s+{_CAPITAL}", rf"(?iu:\bi['’]?m|\bi am)\s+{_CAPITAL}", rf"(?iu:\bthis is)\s+{_CAPITAL}(?iu:\s+speaking)",
    rf"(?iu:мене звати|мене звуть)\s+{_CAPITAL}", rf"(?iu:\bmijn naam is|\bik ben|\bik heet)\s+{_CAPITAL}", r"(?:اسمي|أنا)\s+(\p{L}+)",
]
GREETING = rf"(?iu:\b(?:hi|hello|hey|dear))[,]?\s+(?!I['’](?:m|ve|d|ll)\b){_CAPITAL}"


def _first_name(text: Column, pattern: str) -> Column:
    return F.get(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: ~_one_of(F.lower(w), NOT_NAMES)), F.lit(0))


def introduced_name(text: Column) -> Column:
    """The name in a self-introduction, else null."""
    return F.coalesce(*[_first_name(text, p) for p in INTRODUCTIONS])


def addressed_name(text: Column) -> Column:
    """The capitalised name after a greeting, else null."""
    return _first_name(text, GREETING)


# ---- speaker markers

def _bodies(text: Column) -> Column:
    """What follows each marker, up to the next one."""
    pieces = F.split(text, ft.MARKER)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def diarized(text: Column) -> Column:
    """Array of (speaker, text) of lines such as `Speaker 2: words`; lines without words are left out."""
    speakers = F.transform(F.regexp_extract_all(text, F.lit(ft.MARKER), F.lit(0)), lambda m: F.regexp_extract(m, r"\d+", 0).cast("int"))
    return F.filter(F.zip_with(speakers, _bodies(text), lambda s, b: F.struct(s.alias("speaker"), b.alias("text"))), lambda x: x["text"] != "")


def trim_runaway(text: Column) -> Column:
    """Without the speaker markers at the end whose bodies are empty or the same as the next one's; if the last body is neither empty nor a repeat, nothing is cut."""
    marks, pieces, bodies = F.regexp_extract_all(text, F.lit(ft.MARKER), F.lit(0)), F.split(text, ft.MARKER), _bodies(text)
    n = F.size(marks)
    after = F.concat(F.slice(bodies, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    looped = F.zip_with(bodies, after, lambda a, b: b.isNull() | (a == "") | (a == b))
    other = F.array_position(F.reverse(looped), False)  # 0 if all of them loop
    kept = F.when(other == 0, 0).otherwise(n - other + 1).cast("int")
    start = F.concat(F.get(pieces, F.lit(0)), F.concat_ws("", F.zip_with(F.slice(marks, F.lit(1), kept), F.slice(pieces, F.lit(2), kept), lambda m, p: F.concat(m, p))))
    last, before = F.element_at(bodies, -1), F.get(bodies, n - 2)
    cut = (F.length(text) >= 30) & (n >= 2) & F.when(n >= 2, (last == "") | (last == before)).otherwise(False)
    return F.when(cut, F.regexp_replace(start, r"\s+$", "")).otherwise(text)
