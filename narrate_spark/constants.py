"""Fixed values shared by every operator.

Everything in this module is a fixed value: results only match when these
words, patterns, numbers and formats are exactly as written here.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# In-band prosody markers (only used inside normalized text; tables carry a
# ``kind`` column instead).
SCENE_BREAK_MARKER = "\x00SCENE_BREAK\x00"
CHAPTER_TITLE_MARKER = "\x00CHAPTER_TITLE\x00"

KIND_TEXT = "text"
KIND_SCENE = "scene_break"
KIND_TITLE = "chapter_title"

DEFAULT_MAX_CHARS = 500

# Pauses in milliseconds, and the speaking speed.
PARAGRAPH_PAUSE_MS = 700
CHAPTER_PAUSE_MS = 2500
SCENE_BREAK_PAUSE_MS = 1500
CHAPTER_TITLE_PAUSE_MS = 1200
DEFAULT_SPEED = 1.0
MIN_SPEED = 0.5
MAX_SPEED = 2.0
ACOUSTIC_TAIL_SECONDS = 0.08

# Default PCM format of a generated pause.
DEFAULT_RATE = 24000
DEFAULT_CHANNELS = 1
DEFAULT_WIDTH = 2

# Words that never end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "sra", "srta", "jr", "st", "vs",
    "etc", "inc", "ltd", "corp", "fig", "eq", "vol", "no", "ch", "pp", "ed",
    "trans", "pág", "págs", "art", "d", "dña",
)

# Characters allowed between sentence punctuation and the following blank.
SENTENCE_CLOSERS = "”’\"»—-"
# Characters stripped from the end of a word before the abbreviation lookup.
WORD_TRAILERS = ".!?\"»”’—-"
# A sentence never ends when one of these follows (after an optional dash).
CONTINUATION_LETTERS = "a-záéíóúñ"

# Voice id prefix -> language code, and the language names.
VOICE_PREFIX_LANGUAGE = {
    "a": "en-us",
    "b": "en-gb",
    "j": "ja",
    "z": "zh",
    "e": "es",
    "f": "fr",
    "h": "hi",
    "i": "it",
    "p": "pt-br",
}
PREFIX_LANGUAGE_NAMES = {
    "en-us": "American English",
    "en-gb": "British English",
    "ja": "Japanese",
    "zh": "Mandarin Chinese",
    "es": "Spanish",
    "fr": "French",
    "hi": "Hindi",
    "it": "Italian",
    "pt-br": "Brazilian Portuguese",
}
# Languages of the per-language speech backend.
CHECKPOINT_LANGUAGES = {
    "de": "German",
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "pt": "Portuguese",
}

# Published voice ids of the prefix-coded backend, in catalog order.
PREFIX_VOICES = (
    "af_alloy af_aoede af_bella af_heart af_jessica af_kore af_nicole af_nova "
    "af_river af_sarah af_sky am_adam am_echo am_eric am_fenrir am_liam "
    "am_michael am_onyx am_puck am_santa bf_alice bf_emma bf_isabella bf_lily "
    "bm_daniel bm_fable bm_george bm_lewis jf_alpha jf_gongitsune jf_nezumi "
    "jf_tebukuro jm_kumo zf_xiaobei zf_xiaoni zf_xiaoxiao zf_xiaoyi zm_yunjian "
    "zm_yunxi zm_yunxia zm_yunyang ef_dora em_alex em_santa ff_siwis hf_alpha "
    "hf_beta hm_omega hm_psi if_sara im_nicola pf_dora pm_alex pm_santa"
).split()

# Accepted spellings of the two backends.
BACKEND_ALIASES = {
    "kokoro": "kokoro",
    "phonon": "phonon",
    "phonom": "phonon",
    "phonon-40m": "phonon",
    "phonom-40m": "phonon",
}

# Job states: state -> states it may move to.
TRANSITIONS = {
    "created": ("analyzing", "cancelled"),
    "analyzing": ("ready", "failed", "cancelled"),
    "ready": ("synthesizing", "failed", "cancelled"),
    "synthesizing": ("assembling", "failed", "cancelled"),
    "assembling": ("completed", "failed"),
    "completed": ("synthesizing",),
    "failed": (),
    "cancelled": (),
}
RESUMABLE_STATES = ("created", "ready", "synthesizing", "assembling")
TERMINAL_STATES = ("completed", "failed", "cancelled")

# File suffix -> format.
FORMATS = {
    ".epub": "epub",
    ".txt": "txt",
    ".mobi": "kindle",
    ".azw": "kindle",
    ".azw3": "kindle",
}
OUTPUT_SUFFIXES = (".m4b", ".wav")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp")
HTML_SUFFIXES = (".xhtml", ".html", ".htm")
SPINE_SKIP_IDS = ("nav", "ncx")

# File and directory names, and the fixed lines of chapter metadata.
ARTIFACT_NAME = "ch%04d_seg%06d_chunk%d.wav"
SEGMENT_NAME = "seg_%06d.wav"
CHAPTER_NAME = "ch_%04d"
METADATA_HEADER = ";FFMETADATA1"
METADATA_GENRE = "genre=Audiobook"
METADATA_CHAPTER = "[CHAPTER]"
METADATA_TIMEBASE = "TIMEBASE=1/1000"

# Line patterns (on a stripped line; BLANK and DIGIT are Unicode-aware).
SCENE_LINE = r"[{BLANK}*•\-–—]{3,}"
TITLE_LINE = r"(?iu:Chapter|Capítulo|Cap\.?){BLANK}+{DIGIT}+"
NOISE_LINES = (
    r"[-—–]?{BLANK}*[Pp]age{BLANK}+{DIGIT}+{BLANK}*[-—–]?",
    r"[-—–]?{BLANK}*p\.{BLANK}*{DIGIT}+{BLANK}*[-—–]?",
    r"[-—–]{BLANK}*{DIGIT}+{BLANK}*[-—–]",
    r"[ivxlcdmIVXLCDM]+",
    r"(?iu:Contents|Table of Contents|Índice|Índice de contenidos)",
    r"(?iu:Copyright){BLANK}+©[^\n]*",
    r"(?iu:All rights reserved)\.?",
)
# ------------------------------------------------------------ end fixed values
