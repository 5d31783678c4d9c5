"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and words that announce an
identifier.  Small deterministic parsers then grow each anchor to the left and right and validate what they find, so
the cost beyond the pass follows the number of anchors.  The parsers for the four base kinds return what a leftmost,
non-overlapping search for these patterns returns, failing matches dropped:

  email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip: four dotted numbers, each at most 255; card: digits
  with single blanks or hyphens between, 16 to 19, passing Luhn; phone ``\\+[0-9][ ().0-9-]+[0-9]``, 8 to 15 digits.

Four kinds are added.  ``account``: an identifier cue such as IBAN or passport, then groups of capitals and digits, the
later ones with a digit each, six digits or more; an IBAN ends where its country's length says, or else with the longest
whole groups that pass, and must pass its check.  ``login``: user information inside a scheme's address.  ``url``: the
whole address around a scheme, whose host has a dot or is localhost, without closing marks.  ``postal``: a street word
with its name and house number (``221B Baker Street, Apt 4``, ``Hauptstraße 12``, ``12 rue de la Paix``, ``Calle Mayor 5``).

Every parser reads on from its anchor without going back, or looks at ``LINE`` characters at most, so a text of any kind
takes time in proportion to its length.

Defined cases: null and empty texts have no span; null ids are kept; repeated rows each get their result; an empty
table gives an empty result; other columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from studyloom.llm.shared import col, freed

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "login", "url", "postal")
#: Words that announce an identifier.
CUES = ("iban", "passport", "account number", "account no", "customer id", "social security", "ssn", "tax id", "driver license", "member id")
#: Words of a street, each with the side of its house number.
STREETS = {"Street": "left", "Avenue": "left", "Road": "left", "Lane": "left", "Boulevard": "left", "Drive": "left", "straße": "right", "strasse": "right", "Straße": "right", "Strasse": "right", "rue": "before", "Rue": "before", "Calle": "behind", "calle": "behind"}
#: Characters of an identifier, and of an address on either side of its street word.
IDENTIFIER, LINE = 34, 80
#: Lengths of IBANs.
IBAN_LENGTHS = dict(x.split(":") for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-.")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may stand between a cue and its value; no part gives back what it took.
_BETWEEN = re.compile(r"[ \t]*+(?:(?:is|no|number|nr)\b\.?+)?+[ \t]*+[:=#]?+[ \t]*+")
_GROUP = re.compile(r"[A-Za-z0-9]++")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]++(?::[^\s/@?#]*+)?+@")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]*+")
_AUTHORITY = re.compile(r"[^\s<>\"'`{}|\\^/?#]*+")
_HOST = re.compile(r"(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|localhost)(?::[0-9]++)?")
_CLOSING = ".,;:!?)]*"
_NAMED_LEFT = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,6}[A-Za-z]?(?: [A-Z][\w'-]*){1,4} \Z")
_UNIT = re.compile(r",? (?:Apt|Suite|Unit|Floor)\.? ?[0-9A-Z]{1,6}(?![A-Za-z0-9])")
_NUMBER_RIGHT = re.compile(r" [0-9]{1,5}[a-z]?(?![A-Za-z0-9])")
_NUMBER_BEHIND = re.compile(r",? [0-9]{1,5}(?![A-Za-z0-9])")
_NUMBER_LEFT = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}(?: bis| ter)?,? \Z")
_NAME_RIGHT = re.compile(r"(?: (?:de|du|des|del|la|le|les|los|las))*(?: (?:[dl]['’])?[A-ZÀ-Þ][\w'-]*){1,4}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    v = re.sub("[ -]", "", value)
    return 15 <= len(v) <= 34 and v.isascii() and v.isalnum() and v[:2].isalpha() and v[2:4].isdigit() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def groups_at(text: str, at: int) -> list[tuple[int, int]]:
    """Runs of ASCII letters and digits from ``at`` on with one blank or hyphen between, ``IDENTIFIER`` characters of them at most."""
    out, size = [], 0
    while m := _GROUP.match(text, at, at + IDENTIFIER + 1):
        size += m.end() - at
        if size > IDENTIFIER:
            break
        out.append(m.span())
        at = m.end() + 1
        if text[m.end() : at] not in (" ", "-"):
            break
    return out


def account_at(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier that follows a cue which ends at ``at``."""
    start = _BETWEEN.match(text, at).end()
    if start == at:
        return None  # the cue is the beginning of a longer word
    if cue == "iban" and not (text[start : start + 2].isalpha() and text[start + 2 : start + 4].isdigit()):
        return None
    groups = groups_at(text, start)
    if cue == "iban":
        ends = [end for _, end in groups if iban(text[start:end])]
        wanted = int(IBAN_LENGTHS.get(text[start : start + 2], 0))
        ends = [end for end in ends if not wanted or sum(b - a for a, b in groups if b <= end) == wanted]
        return (start, ends[-1]) if ends else None
    end = start
    for k, (a, b) in enumerate(groups):
        own = text[a:b]
        letters = len(own) - len(own.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if own.upper() != own or own.isalpha() or (letters > 2 if k == 0 else b - a < 2):
            break
        end = b
    return (start, end) if sum(c in _DIGITS for c in text[start:end]) >= 6 else None


def url_at(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The address whose ``://`` stands at ``at``; its scheme begins at ``low`` or later."""
    start = at
    while start > low and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not (text[start].isalpha() and text[start].isascii()):
        start += 1
    authority = _AUTHORITY.match(text, at + 3)  # ends before the next scheme's slashes
    host = authority[0].rpartition("@")[2]
    if start == at or not _HOST.fullmatch(host.rstrip(_CLOSING)):
        return None
    return start, at + 3 + len(_ADDRESS.match(text, at + 3)[0].rstrip(_CLOSING))


def postal_at(text: str, at: int, end: int, low: int) -> tuple[int, int] | None:
    """The street address around the street word from ``at`` to ``end``, beginning at ``low`` or later."""
    side, low, high = STREETS[text[at:end]], max(low, at - LINE), end + LINE
    if side == "right":
        while at > low and text[at - 1].isalpha():
            at -= 1
        number = _NUMBER_RIGHT.match(text, end, high)
        return (at, number.end()) if number and text[at].isupper() and text[at:end].lower() not in STREETS else None
    if text[end : end + 1].isalnum() or at and text[at - 1].isalnum():
        return None
    if side == "left":
        named = _NAMED_LEFT.search(text, low, at)
        unit = _UNIT.match(text, end, high)
        return (named.start(), unit.end() if unit else end) if named else None
    name = _NAME_RIGHT.match(text, end, high)
    if not name:
        return None
    if side == "before":
        number = _NUMBER_LEFT.search(text, low, at)
        return (number.start(), name.end()) if number else None
    number = _NUMBER_BEHIND.match(text, name.end(), high)
    return (at, number.end()) if number else None


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for anchor, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in sorted(_DIGITS))):
        a.add_word(anchor, (kind, len(anchor)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(form, ("cue", len(form)))
    for word in STREETS:
        a.add_word(word, ("street", len(word)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each kind's in order and without overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    mail_end = dotted_end = grouped_end = phone_end = account_end = login_end = url_end = postal_end = 0
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= dotted_end:  # the run's first digit, or the chain's: what stood before was no digit and no dotted digit
                m = _DOTTED.match(text, at)
                dotted_end = m.end()
                if "." in m[0]:
                    parts = [(x.start() + at, x.end() + at) for x in re.finditer("[0-9]+", m[0])]
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        if all(b - a < 4 and int(text[a:b]) <= 255 or int(text[a:b][-3:]) <= 255 and not text[a:b][:-3].strip("0") for a, b in four):
                            out["ip"].append((four[0][0], four[3][1]))
            if at >= grouped_end:
                m = _GROUPED.match(text, at)
                grouped_end = m.end()
                if grouped_end - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((at, grouped_end))
        elif kind == "at":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                out["email"].append((start, mail_end))
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out["phone"].append((at, phone_end))
        elif kind == "scheme":
            if at >= login_end and (m := _LOGIN.match(text, last + 1)):
                login_end = m.end()
                out["login"].append((last + 1, m.end() - 1))
            if at >= url_end and (own := url_at(text, at, url_end)):
                url_end = own[1]
                out["url"].append(own)
        elif kind == "street":
            if at >= postal_end and (own := postal_at(text, at, last + 1, postal_end)):
                postal_end = own[1]
                out["postal"].append(own)
        elif at >= account_end and not (at and text[at - 1].isalnum()) and (own := account_at(text, last + 1, text[at : last + 1].lower())):
            account_end = own[1]
            out["account"].append(own)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, and redacted, the text with each span replaced by its kind."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    kinds = [pa.int64()] * 5 + [pa.string()] * 3
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                found = find(text, anchors) if text else {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
                said = {k: [f"{k}:{a}:{b}" for a, b in v] for k, v in found.items()}
                base = ",".join(x for k in BASE_KINDS for x in said[k])
                everything = ",".join(x for v in said.values() for x in v)
                row = (doc, *(len(found[k]) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), everything, redact(text, found) if everything else text)
                for to, x in zip(out, row, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(freed(run), schema)


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """Each span becomes its kind in angle brackets; of overlapping ones the first in text order stays, the longer at a tie."""
    spans = sorted(((a, -b, k) for k, v in found.items() for a, b in v))
    parts, at = [], 0
    for a, minus_b, k in spans:
        if a >= at:
            parts += [text[at:a], f"<{k}>"]
        at = max(at, -minus_b)
    return "".join([*parts, text[at:]])


def op10_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")
