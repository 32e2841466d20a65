"""Prompts for transcribing and post-processing engines, and names of languages and models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of languages by code, in a system prompt, in a user message, and as hints; others are named by their code.
SYSTEM_NAMES = {"ar": "Arabic (any dialect including Gulf/Qatari)", "uk": "Ukrainian", "en": "English", "nl": "Dutch"}
MESSAGE_NAMES = {"ar": "Gulf Arabic (Qatari dialect)", "uk": "Ukrainian", "en": "English", "nl": "Dutch"}
HINT_NAMES = {"ar": "Arabic (any dialect, including Gulf/Qatari)", "uk": "Ukrainian", "en": "English", "nl": "Dutch (Nederlands)"}
OTHER_NAME = "the language with ISO code '{}'"
#: Embedding models' names by file.
EMBEDDING_MODELS = {"embedding-wespeaker.onnx": "WeSpeaker", "embedding-multilingual.onnx": "CAM++ multilingual", "embedding.onnx": "CAM++ English"}
#: Categories by id.
CATEGORIES = {"meeting": "Meeting", "interview": "Interview", "note": "Note", "idea": "Idea"}
#: Most vocabulary terms in a system prompt, and in a decoder's initial prompt; characters of context; recap that is worth a word.
SYSTEM_TERMS, DECODER_TERMS, CONTEXT_CHARS, RECAP_S = 250, 120, 250, 2.0
#: The sentences of the prompts.
ANY_LANGUAGE = "The audio may be in any language. Detect it from the audio itself."
ONE_OF = ("The audio is in one of: ", ". Detect which language is being spoken and transcribe in that language exactly as heard.")
EXTRAS = "\n\nAdditional instructions:\n- "
VOCABULARY = ("Vocabulary (spell exactly when heard): ", ".")
NO_FILLERS = "Remove filler words: um, uh, uhh, hmm, like, you know, eh, ah, oh."
VERBATIM = "Verbatim mode: do not add punctuation, capitalization, or paragraph breaks. Output a flat stream of spoken words as heard."
PUNCTUATION = "Produce properly formatted written text with full punctuation: end every sentence with a period or question mark, insert commas at natural pauses and in lists, and capitalize sentence starts and proper nouns. "
OUTPUT = "Only output the transcription, with no preamble and no surrounding quotes. When transcribing numbers, write the digits."
CONTINUITY = (
    "\n\n=== CONTEXT (DO NOT TRANSCRIBE OR REPEAT THESE LINES) ===\nContinuity hint — the previous chunk's final words were: ",
    "\n=== END CONTEXT ===\n\nNow transcribe ONLY the audio in the current chunk. Do NOT echo, paraphrase, or quote any text from the CONTEXT block. "
    'Do NOT write phrases like "the previous chunk", "continuing", "as I was saying", or any reference to prior content.',
)
RECAP = ("\n\nThe audio begins with a ", "-second recap of the previous chunk. Begin your transcription at the first new sentence after the recap.")
SPEAKERS = (
    '\n\nThis audio has multiple speakers. Prefix each spoken segment with "Speaker 1: ", "Speaker 2: ", etc. — assigned in the order the speakers first appear. '
    "Use the same Speaker N for the same person throughout. Put each speaker turn on its own line. The speaker labels are part of the required output."
)
HINTS = (
    "\n\nThis audio has multiple speakers. Voice analysis of the full recording identifies the following speaker turns in this segment (times relative to the start of this segment):\n",
    "\nUse exactly these speaker labels (Speaker 1, Speaker 2, …) when transcribing. Prefix each spoken turn with the matching \"Speaker N: \" tag and put each turn on its own line. "
    "Do not invent new speakers; do not renumber. The speaker labels are part of the required output.",
)


def looked_up(code: Column, names: dict[str, str], other: Column | None = None) -> Column:
    """The name of a code in a fixed map, else `other`, else null."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[code], other if other is not None else F.lit(None).cast("string"))


def language_name(code: Column, names: dict[str, str]) -> Column:
    before, after = OTHER_NAME.split("{}")
    return looked_up(code, names, F.concat(F.lit(before), code, F.lit(after)))


def cleaned(languages: Column) -> Column:
    """Codes in lower case, each once, in order."""
    return F.array_distinct(F.transform(languages, F.lower))


def audio_hint(languages: Column) -> Column:
    """What a system prompt says about the languages of the sound."""
    codes = cleaned(languages)
    first = F.get(codes, F.lit(0))
    single = F.concat(F.lit("The audio is in "), looked_up(first, HINT_NAMES, F.concat(F.lit("the language identified by ISO code '"), first, F.lit("'"))), F.lit("."))
    several = F.concat(F.lit(ONE_OF[0]), F.array_join(F.transform(codes, lambda c: language_name(c, SYSTEM_NAMES)), ", "), F.lit(ONE_OF[1]))
    return F.when(F.size(codes) == 0, ANY_LANGUAGE).when(F.size(codes) == 1, single).otherwise(several)


def transcript_hint(language: Column) -> Column:
    """What a post-processing prompt says about the language of a transcript."""
    code = F.lower(language)
    said = F.concat(F.lit("The transcript is in "), looked_up(code, HINT_NAMES, F.concat(F.lit("language code '"), language, F.lit("'"))), F.lit("."))
    return F.when(F.coalesce(code, F.lit("")).isin("", "auto"), "The transcript may be in any language.").otherwise(said)


def extras(terms: Column, no_fillers: Column, verbatim: Column, tone: Column) -> Column:
    """The list of additional instructions, empty if there are none; at most `SYSTEM_TERMS` terms are named."""
    words = F.array_join(F.slice(terms, 1, SYSTEM_TERMS), ", ")
    parts = F.filter(F.array(F.when(F.size(terms) > 0, F.concat(F.lit(VOCABULARY[0]), words, F.lit(VOCABULARY[1]))), F.when(no_fillers, NO_FILLERS), F.when(verbatim, VERBATIM), tone), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit(EXTRAS), F.array_join(parts, "\n- ")))


def system_prompt(template: Column, languages: Column, terms: Column, no_fillers: Column, verbatim: Column, tone: Column) -> Column:
    return F.concat(F.replace(template, F.lit("{language_hint}"), audio_hint(languages)), extras(terms, no_fillers, verbatim, tone))


def decoder_prompt(terms: Column) -> Column:
    """Terms that prime a decoder, at most `DECODER_TERMS`."""
    return F.array_join(F.slice(terms, 1, DECODER_TERMS), ", ")


def user_message(languages: Column, target: Column, verbatim: Column, context: Column, recap_s: Column, hints: Column, diarize: Column) -> Column:
    """The message next to a chunk of sound: what to do, the words before, the recap, and the speakers.

    `target` is the language to translate to, or null; `hints` is an array of (from_s, to_s, speaker) or null.
    """
    codes = cleaned(languages)
    names = F.array_join(F.transform(codes, lambda c: language_name(c, MESSAGE_NAMES)), " or ")
    source = F.when(F.size(codes) == 0, "the source language").when(F.size(codes) == 1, names).otherwise(F.concat(F.lit("one of "), names))
    translate = F.concat(F.lit("Translate the following speech segment in "), source, F.lit(" into natural "), language_name(target, MESSAGE_NAMES), F.lit(" text. "))
    transcribe = (
        F.when(F.size(codes) == 0, "Transcribe the following speech segment into text in its spoken language. ")
        .when(F.size(codes) == 1, F.concat(F.lit("Transcribe the following speech segment in "), names, F.lit(" into "), names, F.lit(" text. ")))
        .otherwise(F.concat(F.lit("Transcribe the following speech segment into text. The speech is in "), names, F.lit("; detect which and transcribe in that language exactly as heard. ")))
    )
    core = F.concat(F.when(target.isNotNull(), translate).otherwise(transcribe), F.when(verbatim, "").otherwise(PUNCTUATION), F.lit(OUTPUT))
    before = F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat(F.lit(CONTINUITY[0]), F.right(context, F.lit(CONTEXT_CHARS)), F.lit(CONTINUITY[1]))).otherwise("")
    recap = F.when(recap_s >= RECAP_S, F.concat(F.lit(RECAP[0]), F.format_string("%.1f", recap_s), F.lit(RECAP[1]))).otherwise("")
    lines = F.transform(hints, lambda h: F.concat(F.lit("- "), F.format_string("%.1f–%.1fs: Speaker %d\n", h["from_s"], h["to_s"], h["speaker"] + 1)))
    voices = F.when(F.coalesce(F.size(hints), F.lit(0)) > 0, F.concat(F.lit(HINTS[0]), F.array_join(lines, ""), F.lit(HINTS[1]))).when(diarize, SPEAKERS).otherwise("")
    return F.concat(core, before, recap, voices)
