"""Text functions: the normal form, tokens, keys, guard-model outputs and prompts.

All but ``normalize_exact`` and ``fast_key`` are built-in expressions.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Categories of the guard model.
GUARD_CATEGORIES = (
    "Violent",
    "Non-violent Illegal Acts",
    "Sexual Content or Sexual Acts",
    "PII",
    "Suicide & Self-Harm",
    "Unethical Acts",
    "Politically Sensitive Topics",
    "Copyright Violation",
    "Jailbreak",
)
_CATEGORY = "(" + "|".join((*GUARD_CATEGORIES, "None")) + ")"
_LABEL = r"(?i)Safety:\s*(Safe|Unsafe|Controversial)"
#: Severity of a guard label.
SEVERITY = {"safe": 0, "controversial": 1, "unsafe": 2}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(text: str) -> str:
    """Decomposed, marks dropped, recomposed, simple lower case, stand-in signs folded."""
    text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))
    return "".join(LEET.get(x, x) for x in (c.lower() if len(c.lower()) == 1 else c for c in text))


@cache
def _fold_table() -> tuple[str, str]:
    """Every character whose normal form is one other character, and those forms."""
    pairs = []
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if (c.lower() == c and not unicodedata.decomposition(c) and c not in LEET) or unicodedata.category(c) in ("Cs", "Cn", "Co"):
            continue
        to = _plain(c)
        if len(to) == 1 and to != c:
            pairs.append((c, to))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _longer_forms() -> dict[str, str]:
    """Characters whose normal form has several characters."""
    return {c: to for cp in range(0x80, sys.maxunicode + 1) if unicodedata.category(c := chr(cp)) not in ("Cs", "Cn", "Co") and len(to := _plain(c)) > 1}


@cache
def _compositions() -> dict[str, str]:
    """Pairs of characters, neither a non-spacing mark, that compose to one, but for Hangul."""
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(cp)).split()
        if len(d) == 2 and not d[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in d)
            if "Mn" not in (unicodedata.category(pair[0]), unicodedata.category(pair[1])) and unicodedata.normalize("NFC", pair) == chr(cp):
                out[pair] = chr(cp)
    return out


#: Conjoining letters of Hangul (first, vowel, last), and its syllables.
_FIRST, _VOWEL, _LAST, _SYLLABLE = "\u1100-\u1112", "\u1161-\u1175", "\u11a8-\u11c2", "\uac00-\ud7a3"


def _syllable(x: Column) -> Column:
    """Conjoining letters composed to a syllable by their published arithmetic."""
    code = lambda i: F.ascii(F.substring(x, i, 1))
    last = lambda i: F.when(F.length(x) >= i, code(i) - 0x11A7).otherwise(0)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE")
    whole = F.when((code(1) - 0xAC00) % 28 == 0, char(code(1) + last(2))).otherwise(x)
    return F.when(code(1) < 0x1200, char(0xAC00 + ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28 + last(3))).otherwise(whole)


def normalize(c: Column | str) -> Column:
    """The normal form for matching, as one JVM expression: a character table and a removal of
    combining marks. Texts with characters whose form is longer than one character, or that
    compose with their neighbours, take a slower branch. Null stays null."""
    c = _col(c)
    plain = F.regexp_replace(F.translate(c, *_fold_table()), r"\p{Mn}+", "")
    longer, pairs = _longer_forms(), _compositions()
    known = F.create_map(*[F.lit(x) for pair in (longer | pairs).items() for x in pair])
    units = f"[{_FIRST}][{_VOWEL}][{_LAST}]?|[{_SYLLABLE}][{_LAST}]|{'|'.join(pairs)}|[\\s\\S]"
    slow = F.transform(F.regexp_extract_all(plain, F.lit(units), F.lit(0)), lambda x: F.coalesce(F.try_element_at(known, x), F.when(F.length(x) > 1, _syllable(x)), x))
    rare = "[" + "".join(sorted({*longer, *(p[1] for p in pairs)})) + f"{_VOWEL}{_LAST}]"
    return F.when(F.rlike(c, F.lit(rare)), F.array_join(slow, "")).otherwise(plain)


@F.pandas_udf(T.StringType())
def normalize_exact(s: pd.Series) -> pd.Series:
    """The normal form of every string without exception, in Arrow batches."""
    return s.map(_plain, na_action="ignore")


def tokens(c: Column | str) -> Column:
    """Runs of ASCII letters, digits, underscore and any character from U+0080 on."""
    return F.regexp_extract_all(_col(c), F.lit(r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+"), F.lit(0))


def merge_categories(a: Column | str, b: Column | str) -> Column:
    """Sorted set union; a null side counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(_col(a), none), F.coalesce(_col(b), none)))


def sha_key(c: Column | str) -> Column:
    """64-digit key of a text as submitted."""
    return F.sha2(_col(c), 256)


@F.pandas_udf(T.StringType())
def fast_key(s: pd.Series) -> pd.Series:
    """16-digit key of a normalized text: xxHash64 with seed 0, little-endian bytes in hex."""
    import xxhash

    return s.map(lambda t: xxhash.xxh64_intdigest(t).to_bytes(8, "little").hex(), na_action="ignore")


# --- guard models ---------------------------------------------------------------------------


def _categories(c: Column, flags: str) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(flags + _CATEGORY), F.lit(1)), lambda x: F.lower(x) != "none" if flags else x != "None")


def parse_scorer_output(c: Column | str) -> Column:
    """struct(is_nsfw, safety_label, categories) of the text scorer's answer.

    The label keeps its spelling and is ``Unknown`` where there is none; categories match case.
    """
    c = F.coalesce(_col(c), F.lit(""))
    label = F.regexp_extract(c, _LABEL, 1)
    return F.struct((F.lower(label) == "unsafe").alias("is_nsfw"), F.when(label == "", "Unknown").otherwise(label).alias("safety_label"), _categories(c, "").alias("categories"))


def parse_guard_labels(c: Column | str) -> Column:
    """struct(is_safe, severity, categories) of a label-style guard; unreadable answers are safe."""
    c = F.coalesce(_col(c), F.lit(""))
    label = F.lower(F.regexp_extract(c, _LABEL, 1))
    severity = F.lit(0)
    for name, n in SEVERITY.items():
        severity = F.when(label == name, n).otherwise(severity)
    return F.struct((severity == 0).alias("is_safe"), severity.alias("severity"), F.when(label == "", F.array().cast("array<string>")).otherwise(_categories(c, "(?i)")).alias("categories"))


def parse_guard_codes(c: Column | str) -> Column:
    """struct(is_safe, categories) of a code-style guard: ``unsafe`` and codes on the next line."""
    lines = F.split(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), "\n")
    unsafe = F.get(lines, F.lit(0)).startswith("unsafe")
    codes = F.transform(F.split(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    return F.struct((~unsafe).alias("is_safe"), F.when(unsafe, F.filter(codes, lambda x: x.startswith("S"))).otherwise(F.array().cast("array<string>")).alias("categories"))


def category_description(c: Column | str) -> Column:
    """Names describe themselves; unknown ones pass through."""
    return _col(c)


#: The four prompts of the guard models; {user} and {assistant} are filled in.
LLAMA_USER = """<|begin_of_text|><|start_header_id|>user<|end_header_id|>

Task: Check if there is unsafe content in 'User' message.

<BEGIN CONVERSATION>
User: {user}
<END CONVERSATION>

Provide your safety assessment for ONLY the last User message.
<|eot_id|><|start_header_id|>assistant<|end_header_id|>"""
LLAMA_PAIR = """<|begin_of_text|><|start_header_id|>user<|end_header_id|>

Task: Check if there is unsafe content in the conversation.

<BEGIN CONVERSATION>
User: {user}
Assistant: {assistant}
<END CONVERSATION>

Provide your safety assessment for ONLY the last message.
<|eot_id|><|start_header_id|>assistant<|end_header_id|>"""
GENERIC_USER = """You are a content safety classifier. Analyze the following user message and determine if it contains unsafe content.

Categories to check:
- S1: Violent Crimes
- S2: Non-Violent Crimes\x20\x20
- S3: Sex-Related Crimes
- S4: Child Sexual Exploitation
- S5: Defamation
- S6: Privacy Violations
- S7: Intellectual Property
- S8: Weapons
- S9: Hate Speech
- S10: Suicide/Self-Harm
- S11: Sexual Content

User message: "{user}"

Respond with ONLY one of:
- "safe" if the content is safe
- "unsafe\\nS1,S2,..." listing violated category codes if unsafe"""
GENERIC_PAIR = """You are a content safety classifier. Analyze the following conversation.

Categories to check:
- S1: Violent Crimes
- S2: Non-Violent Crimes
- S3: Sex-Related Crimes
- S4: Child Sexual Exploitation
- S5: Defamation
- S6: Privacy Violations
- S7: Intellectual Property
- S8: Weapons
- S9: Hate Speech
- S10: Suicide/Self-Harm
- S11: Sexual Content

User: "{user}"
Assistant: "{assistant}"

Respond with ONLY one of:
- "safe" if the content is safe
- "unsafe\\nS1,S2,..." listing violated category codes if unsafe"""


def guard_prompt(user: Column | str, assistant: Column | str, model: Column | str) -> Column:
    """The prompt for a user message, or for a user and assistant pair; by model family.

    A null or empty assistant message asks about the user message alone.
    """
    user, assistant, name = _col(user), F.coalesce(_col(assistant), F.lit("")), F.lower(_col(model))
    llama = F.contains(name, F.lit("llama-guard")) | F.contains(name, F.lit("llamaguard"))
    single = assistant == ""

    def fill(template: str) -> Column:
        before, after = template.split("{user}")
        middle, *end = after.split("{assistant}")
        return F.concat(F.lit(before), user, F.lit(middle), *([assistant, F.lit(end[0])] if end else []))

    return F.when(llama & single, fill(LLAMA_USER)).when(llama, fill(LLAMA_PAIR)).when(single, fill(GENERIC_USER)).otherwise(fill(GENERIC_PAIR))
