"""Personal data in free text: finding it, and typed placeholders with linked pseudonyms.

Items are found in the text as submitted and in the service's folded form, where digits and
signs have turned into letters (``call me on +aa ttoo 9oo126``); a folded number is read back
into its digits. Placeholders hold a pseudonym of the same format: digits, letters and valid
dates are permuted within their format by a keyed Feistel network, so equal values stay linked
across documents and differently written ones too, while the values themselves are gone.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardsieve.llm.sentences import _LOOK, SIGNS
from wardsieve.runtime import load, spread

KINDS = ("email", "phone", "id", "address", "name")

#: Given names.
GIVEN = """
adam alan alice alicia amanda amelia amy andrea andrew angela anna anne anthony arthur barbara benjamin bernard brian bruce
carla carol caroline catherine charles charlotte christina christopher clara claire colin daniel david deborah dennis diana donald
dorothy douglas edward edwin eleanor elena elizabeth ellen emily emma eric erica ethan eva felix fiona florence frances frank
frederick gabriel gary george gerald gloria grace graham gregory hannah harold harriet harry heather helen henry howard hugo ian
irene isabel jack jacob james jane janet jason jeffrey jennifer jeremy jessica joan john jonathan joseph joshua joyce judith julia
julian karen karl katherine kathleen keith kenneth kevin laura lawrence leo leonard lewis linda lisa louis louise lucas lucy margaret
maria marie marcus mark marta martha martin mary matthew max michael michelle monica nancy naomi nathan nicholas nicole nina nora
norman oliver olivia oscar pamela patricia patrick paul paula peter philip rachel ralph raymond rebecca richard robert roger rosa
rose russell ruth samuel sandra sarah sharon simon sophia sophie stephen stella steven susan sylvia teresa theodore theresa thomas
timothy vera victor victoria vincent walter wendy william yvonne zoe
""".split()  # fmt: skip
#: Endings of family names, and of streets.
FAMILY = "berg|by|croft|dale|den|field|ford|gate|ham|holm|ings|kin|land|ley|lund|man|mont|more|ner|ander|quist|rell|ric|sen|shaw|son|stead|tane|ton|vale|well|wick|wood|worth|wynd"
STREETS = "street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|close|cl|way|place|terrace|crescent|boulevard|blvd"
TOWNS = "by|mere|wick|ton|ford|haven|stead|ury|bury|ham|field|port|ville|ley"
#: What precedes an address, for folded numbers that read like words.
PLACES = r"lives?|house|home|deliver(?:ed)?|parcel|package|come|meet|address|at|to|is|for"
#: Verbs after a given name alone.
VERBS = "would|said|says|told|has|had|is|was|will|wants|asked"
DOMAINS = "com|net|org|invalid|test|example|info|edu|gov|io"

_FOLDED = {ord(k): v for k, v in SIGNS.items()}
_UNFOLD = {ord(v): k for k, v in SIGNS.items() if k.isdigit()}
_I = re.IGNORECASE


def _number_patterns(d: str, lit) -> list[tuple[str, re.Pattern]]:
    """Phones and ids with digit class ``d``; ``lit`` writes literal digits."""
    edge, end = r"(?<![\w+.-])", r"(?![\w-])"
    phones = [
        rf"\+{lit('44')} ?\({lit('0')}\) ?{d}{{2,4}} {d}{{3,4}} {d}{{4}}",
        rf"(?:\+{lit('44')} |{lit('0')}){d}{{4}} {d}{{3}} ?{d}{{3}}",
        rf"(?:\+{lit('1')}[ -]|{lit('001')}-|{lit('1')}-)?(?:\({d}{{3}}\) ?|{d}{{3}}[-.]){d}{{3}}[-.]{d}{{4}}",
        rf"\+{lit('1')} {d}{{3}} {d}{{3}} {d}{{4}}",
        rf"\+{d}{{2,3}}(?: {d}{{2,5}}){{2,4}}(?=\W|$)",
        rf"\({lit('0')}{d}{{2,4}}\) ?{d}{{3,4}} {d}{{4}}",
    ]
    if not lit("0").isalpha():  # without blanks a folded number is a word
        phones += [r"\+[1-9]\d{9,13}", r"07\d{9}"]
    ids = [rf"{d}{{3}}-{d}{{2}}-{d}{{4}}", rf"{d}{{6}}-{d}{{4}}"]
    return [("phone", re.compile(rf"(?<![\w+-])(?:{'|'.join(phones)}){end}", _I)), ("id", re.compile(rf"{edge}(?:{'|'.join(ids)}){end}", _I))]


class _Mode:
    """Patterns of one writing: as submitted, or folded."""

    def __init__(self, folded: bool):
        self.folded = folded
        d = "[oieastb269]" if folded else r"\d"
        lit = (lambda s: s.translate(_FOLDED)) if folded else (lambda s: s)
        self.numbers = _number_patterns(d, lit)
        if folded:
            loose = rf"(?:(?<=passport )|(?<=passport no\. )|(?<=passport number is ))[^\W\d_]{{2}}{d}{{7}}\b|\b[^\W\d_]{{2}}(?={d}{{0,6}}[269]){d}{{7}}\b"
            nino = rf"\bqq ?{d}{{2}} ?{d}{{2}} ?{d}{{2}} ?[a-d]\b|\b[^\W\d_]{{2}} (?={d}{{0,2}} ?{d}{{0,2}} ?{d}?[269]){d}{{2}} {d}{{2}} {d}{{2}} [a-d]\b"
            licence = rf"\b[^\W\d_]{{5}}{d}{{6}}[a-z0-9]{{2}}{d}[a-z]{{2}}\b"
        else:
            loose, nino, licence = r"(?:(?<=passport )|(?<=passport no\. )|(?<=passport number )|(?<=passport number is ))\d{9}\b|\b[^\W\d_]{2}\d{7}\b", r"\b[^\W\d_]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]\b", r"\b[^\W\d_]{5}\d{6}[a-z0-9]{5}\b"
        self.ids = re.compile(rf"(?<![\w-])(?:{licence}|{nino}|{loose})(?![\w-])", _I)
        flat = r"(?:(?:flat|apt|apartment|unit)\.? ?\w{1,4},? )?"
        # a town of any name is known by its code, one without by its ending
        town = rf"(?:, [^\W\d_]{{3,20}} {d}{{5}}\b|, [^\W\d_]{{1,12}}(?:{TOWNS})\b)?"
        number = rf"{d}{{1,4}}[a-z]?"
        self.address = re.compile(rf"(?<![\w#@.,-])(?P<flat>{flat})(?P<num>{number}) (?P<road>[^\W\d_]{{4,15}}) (?:{STREETS})\b\.?(?P<town>{town})", _I)


_LABEL = r"(?:[^\W_]|-){1,63}"
_AT = re.compile(r"@|\s?[(\[{]\s?at\s?[)\]}]\s?", _I)
_LOCAL = re.compile(r"(?:mailto:)?[\w.+%'-]{1,64}$", _I)
_HOST = re.compile(rf"{_LABEL}(?:(?:\.|\s?[(\[{{]\s?dot\s?[)\]}}]\s?){_LABEL}){{1,5}}", _I)
_TOP = re.compile(rf"\.(?:{DOMAINS})(?![\w/.-]\w|[/_-])", _I)
_TOKEN = re.compile(r"[\w.+:/-]{1,140}$")
_FOLDED_MAIL = re.compile(rf"(?:mailto:)?(?!www\.)[\w.+-]{{2,64}}a{_LABEL}(?:\.{_LABEL}){{1,4}}", _I)


def _emails(seen: str, folded: bool) -> Iterator[tuple[int, int]]:
    """Addresses around each at sign, plain or spelled out; in folded text the sign is an ``a``
    within a word that ends as a domain does."""
    for m in _AT.finditer(seen):
        low = max(0, m.start() - 80)
        local, host = _LOCAL.search(seen[low : m.start()]), _HOST.match(seen, m.end())
        if local and host:
            yield low + local.start(), host.end()
    if folded:
        for m in _TOP.finditer(seen):
            low = max(0, m.start() - 140)
            token = _TOKEN.search(seen[low : m.end()])
            if token and _FOLDED_MAIL.fullmatch(token.group()):
                yield low + token.start(), m.end()


_AS_IS, _IN_FOLD = _Mode(False), _Mode(True)
_GIVEN = frozenset(GIVEN)
_L = r"[^\W\d_]"
_FAMILY = rf"{_L}{{1,14}}(?:{FAMILY})(?:-{_L}{{2,18}})?"
_WORD = re.compile(rf"{_L}+")
_AFTER = re.compile(rf"\.? (?:{_L}\.? )?{_FAMILY}\b", _I)
_AFTER_TITLE = re.compile(rf" (?:[A-Z]\. )?[A-Z][^\W\d_A-Z]{{3,18}}(?:-{_L}{{2,18}})?\b")
_CAPITAL = rf"[A-Z][^\W\d_A-Z]{{1,18}}(?:[-'’][A-Z]?[^\W\d_A-Z]{{1,18}})?"
#: Titles, and what introduces a person's full name, whatever the name.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof)\b\.?"
_NO_NAME = r"(?!(?:Street|Road|Lane|Avenue|Drive|Court|Close|Way|Place|Park|Square)\b)"
_INTRODUCED = re.compile(rf"\b(?:{_TITLE}|(?:[Mm]y name is|[Ss]igned,?|[Ss]incerely,|[Rr]egards,)(?: {_TITLE})?) (?!{_TITLE})(?P<name>{_CAPITAL}(?: [A-Z]\.)? {_NO_NAME}{_CAPITAL})\b")
_BEFORE = re.compile(rf"\b{_FAMILY}, $", _I)
_ALONE = re.compile(rf"(?: {_L}\.)?(?! (?:{VERBS})\b)(?!['’\w])", _I)


def _names(seen: str) -> Iterator[tuple[int, int]]:
    """Given names from the list with a family name after them, or before them and a comma; then
    two capitalised words of any kind after a title or an introduction."""
    upto = 0
    for m in _WORD.finditer(seen):
        if m.start() < upto or m.group().lower() not in _GIVEN:
            continue
        after = _AFTER.match(seen, m.end()) or (_AFTER_TITLE.match(seen, m.end()) if m.group().istitle() else None)
        if after:
            upto = after.end()
            yield m.start(), upto
            continue
        start = max(upto, m.start() - 40)
        before = _BEFORE.search(seen[start : m.start()])
        if before and (alone := _ALONE.match(seen, m.end())):
            upto = alone.end()
            yield start + before.start(), upto
    for m in _INTRODUCED.finditer(seen):
        yield m.span("name")


_WORDLIKE = re.compile(r"(?i)^(?:a|i|o|e|s|t|b|as|at|be|is|it|so|to|bet|eat|sea|tea|toe|sit|sat|set|bat|bit|boat|test|best|oat|ease|seat|east|boo|too|see|bee|tie|toes|sets|bits|oats)$")
_PLACE = re.compile(rf"(?i)\b(?:{PLACES}) (?:flat [\w]{{1,4}},? )?$")
_FOLDED_TEXT = re.compile(r"[A-Z01345780@$]")


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all items, in order, without overlap.

    A text is taken as folded if it holds no capital and none of the folded digits and signs.
    Null and empty texts have no items. Invisible and look-alike characters inside an item do
    not hide it.
    """
    if not text:
        return []
    seen, place = text, None
    if not text.isascii():
        kept = [i for i, c in enumerate(text) if _LOOK.get(ord(c), c) is not None]
        seen = "".join(_LOOK.get(ord(text[i]), text[i]) for i in kept)
        place = kept
    mode = _IN_FOLD if not _FOLDED_TEXT.search(seen) else _AS_IS
    taken = bytearray(len(seen))
    out: list[tuple[str, int, int]] = []

    def take(kind: str, start: int, end: int) -> None:
        if end > start and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append((kind, start, end))

    for start, end in _emails(seen, mode.folded):
        take("email", start, end)
    for kind, pattern in mode.numbers:
        for m in pattern.finditer(seen):
            take(kind, m.start(), m.end())
    for m in mode.ids.finditer(seen):
        take("id", m.start(), m.end())
    for m in mode.address.finditer(seen):
        num = m["num"]
        if mode.folded and not m["flat"] and _WORDLIKE.match(num) and not _PLACE.search(seen, max(0, m.start() - 40), m.start()):
            continue
        take("address", m.start(), m.end())
    for start, end in _names(seen):
        take("name", start, end)
    out.sort(key=lambda x: x[1])
    if place:
        out = [(k, place[a], place[b - 1] + 1) for k, a, b in out]
    return out


# --- pseudonyms -----------------------------------------------------------------------------


class Feistel:
    """A keyed permutation of 0..n-1 for any n: eight rounds on two halves, walked into range."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    def _round(self, tag: str, i: int, half: int, width: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tag}|{i}|{half}".encode(), hashlib.sha256)[:16], "big") & ((1 << width) - 1)

    def permute(self, x: int, n: int, tag: str = "", *, back: bool = False) -> int:
        if n < 2:
            return x
        w = max(1, -(-(n - 1).bit_length() // 2))
        low = (1 << w) - 1
        while True:
            a, b = x >> w, x & low
            for i in reversed(range(self.rounds)) if back else range(self.rounds):
                a, b = (b ^ self._round(tag, i, a, w), a) if back else (b, a ^ self._round(tag, i, b, w))
            x = a << w | b
            if x < n:
                return x


_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2000, 1, 1) - date(1900, 1, 1)).days
_NATIONAL = re.compile(r"^(\d{2})(\d{2})(\d{2})-(\d{4})$")
_SOCIAL = re.compile(r"^(\d{3})-(\d{2})-(\d{4})$")


def plain(kind: str, value: str) -> str:
    """The form in which equal values are equal: folded digits read back, case and spacing gone."""
    v = " ".join("".join(c for c in value if _LOOK.get(ord(c), c) is not None).split())
    if kind in ("phone", "id"):
        v = v.upper()
        if not any(c in "01345780" for c in v) or not any(c.isdigit() for c in v):
            v = _unfold_number(v.lower()).upper()
        return v
    v = v.lower()
    if kind == "email":
        v = re.sub(r"\s?[(\[{]\s?(at|dot)\s?[)\]}]\s?", lambda m: "@" if m[1] == "at" else ".", v.removeprefix("mailto:"))
    return v.translate(_FOLDED)


def _unfold_number(v: str) -> str:
    """Letters that stand for digits, at the places where the formats hold digits."""
    m = re.match(r"^([^\W\d_]{5})(\w{6})(\w{2})(\w)(\w{2})$", v) or re.match(r"^([^\W\d_]{2})(\w{7})()()()$", v)
    if m:
        return m[1] + m[2].translate(_UNFOLD) + m[3] + m[4].translate(_UNFOLD) + m[5]
    m = re.match(r"^([^\W\d_]{2}) ?(.{6,8}?) ?([^\W\d_])$", v)
    if m:
        return f"{m[1]} {m[2].translate(_UNFOLD)} {m[3]}"
    return v.translate(_UNFOLD)


def _issued(area: int, group: int, serial: int) -> bool:
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _no_date(v: str, feistel: Feistel) -> str:
    """A dated number without a valid date stays one: its image is walked until it has none."""
    n = int(v[:6] + v[7:])
    while True:
        n = feistel.permute(n, 10**10, "undated")
        out = f"{n // 10_000:06d}"
        try:
            date(1900 + int(out[:2]), int(out[2:4]), int(out[4:]))
        except ValueError:
            return f"{out}-{n % 10_000:04d}"


def pseudonym(kind: str, value: str, feistel: Feistel) -> str:
    """The stand-in of a value: same format for numbers, a linked code for the rest."""
    v = plain(kind, value)
    if kind not in ("phone", "id"):
        n = int.from_bytes(hmac.digest(feistel.key, f"{kind}|{v}".encode(), hashlib.sha256)[:10], "big")
        return f"{feistel.permute(n, 1 << 80, kind):020x}"
    m = _NATIONAL.match(v)
    if m:
        try:  # a valid date stays a valid date, and is permuted with its serial as one number
            day = (date(1900 + int(m[1]), int(m[2]), int(m[3])) - _FIRST_DAY).days
        except ValueError:
            return _no_date(v, feistel)
        born, serial = divmod(feistel.permute(day * 10_000 + int(m[4]), _DAYS * 10_000, "born"), 10_000)
        return f"{_FIRST_DAY + timedelta(born):%y%m%d}-{serial:04d}"
    m = _SOCIAL.match(v)
    if m and _issued(*map(int, m.groups())):
        # an issued number stays one: area 1 to 899 but 666, group and serial not 0
        area = int(m[1]) - 1 - (int(m[1]) > 666)
        n = (area * 99 + int(m[2]) - 1) * 9_999 + int(m[3]) - 1
        n, serial = divmod(feistel.permute(n, 898 * 99 * 9_999, "issued"), 9_999)
        area, group = divmod(n, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
    digits = [i for i, c in enumerate(v) if c.isdigit()]
    letters = [i for i, c in enumerate(v) if "A" <= c <= "Z"]
    shape = "".join("9" if c.isdigit() else "A" if "A" <= c <= "Z" else c for c in v)
    keep = 0
    if v.startswith("+"):  # the country is part of the format
        keep = len(re.match(r"\+\d*", v)[0]) - 1
    out = list(v)
    at = digits[keep:]
    if at:
        n = feistel.permute(int("".join(v[i] for i in at)), 10 ** len(at), f"{kind}|{shape}")
        for i, c in zip(at, f"{n:0{len(at)}d}", strict=True):
            out[i] = c
    if letters:
        n = 0
        for i in letters:
            n = n * 26 + ord(v[i]) - 65
        n = feistel.permute(n, 26 ** len(letters), f"{kind}|{shape}|letters")
        for i in reversed(letters):
            n, r = divmod(n, 26)
            out[i] = chr(65 + r)
    return "".join(out)


def redact(text: str | None, feistel: Feistel) -> tuple[str | None, list[str]]:
    """The text with ``[KIND pseudonym]`` for each item, everything else as it was; and the kinds
    of its placeholders in order."""
    out, kinds, upto = [], [], 0
    for kind, a, b in find(text):
        out += [text[upto:a], f"[{kind.upper()} {pseudonym(kind, text[a:b], feistel)}]"]
        kinds.append(kind)
        upto = b
    return ("".join([*out, text[upto:]]) if out else text), kinds


# --- operators ------------------------------------------------------------------------------


def redacted(rows: DataFrame, key: bytes) -> DataFrame:
    """(key column, text, kinds): the texts with placeholders, and their kinds in order. Null
    texts stay null. Whoever has ``key`` can link values, so there is no default."""
    name = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for b in batches:
            texts, kinds = zip(*(redact(t, feistel) for t in b.column(1).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], [name, "text", "kinds"])

    return rows.mapInArrow(run, f"`{name}` {rows.schema[name].dataType.simpleString()}, text string, kinds array<string>")


def items(done: DataFrame) -> DataFrame:
    """(key column, kind, nth): the placeholders of ``redacted`` texts; nth counts a kind within a
    row from 1."""
    name = done.columns[0]
    one = done.select(name, F.posexplode("kinds").alias("at", "kind"), "kinds")
    return one.select(name, "kind", F.size(F.filter(F.slice("kinds", F.lit(1), F.col("at") + 1), lambda k: k == F.col("kind"))).alias("nth"))


def _rows(spark, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "text_dataset").select("id", F.col("normalized_content").alias("text")))


#: Setting that holds the key as text; without it every application draws one of its own.
KEY_SETTING = "wardsieve.pseudonym.key"
_DRAWN = secrets.token_bytes(32)


def _key(spark) -> bytes:
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _DRAWN


def p1_found(spark, sf_dir: str) -> DataFrame:
    """(id, kind, nth) of the placeholders."""
    return items(redacted(_rows(spark, sf_dir), _key(spark)).select("id", "kinds"))


def p1_redacted(spark, sf_dir: str) -> DataFrame:
    """(id, text, n_items)."""
    return redacted(_rows(spark, sf_dir), _key(spark)).select("id", "text", F.size("kinds").alias("n_items"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
ORACLES: dict[str, str] = {}
