"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, schemes and identifier cues.  At each anchor a deterministic
parser expands to the boundaries of a candidate and validates it:

* ``email``: local part to the left of an at-sign, dotted domain to its right;
* ``ip``: four dotted numbers of at most 255;
* ``card``: 16 to 19 digits, single blanks or hyphens between, Luhn checksum;
* ``phone``: a plus sign and 8 to 15 digits;
* ``url``: an address that a scheme introduces, with a host;
* ``account``: behind a cue such as IBAN or an account word, an identifier with
  a right ISO 7064 checksum or of 6 to 17 digits;
* ``secret``: behind a cue such as token, key or password and a sign of
  assignment, a credential that is long enough, has digits and letters and spreads
  over enough different characters; or a block of a private key.

Cues and schemes count in any letter case.

Candidates of a kind don't overlap, the leftmost wins, and one that fails its
validation is dropped without a second try.  Kinds are independent of each
other: a span of one may lie in a span of another.  Offsets are code points,
ends exclusive.  Null and empty texts hold nothing; null ids pass through; very
long texts are read in one pass; equal texts have equal spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import fields, map_batches

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
#: Cues that introduce an account identifier, and schemes of addresses.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn")
KEYS = ("token", "secret", "key", "apikey", "bearer", "authorization", "credential", "credentials", "signature")
PASSWORDS = ("password", "passwd", "passphrase", "passwort", "pwd")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "ws://", "wss://")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
RUN = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s/?#<>\"']+(?:[/?#][^\s<>\"']*)?")
GAP = re.compile(r"(?: ?(?:number|no\.?|nr\.?|nummer|#))?[ \t]*[:=#]?[ \t]*", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ASSIGNED = re.compile(r"[\"']?\s{0,3}(?:[:=]>?|:=)\s{0,3}(?:(?:bearer|basic)\s)?[\"']?", re.IGNORECASE)
KEY = re.compile(r"[A-Za-z0-9+/_.~-]{16,}={0,2}")
PASSWORD = re.compile(r"[^\s\"'<>,;]{8,128}")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[^-]*-----END \1-----")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in "@+0123456789":
        found.add_word(mark, (mark, 1))
    for scheme in SCHEMES:
        found.add_word(scheme, ("url", len(scheme)))
    for cue in CUES:
        found.add_word(cue, ("account", len(cue)))
    for kind, cues in (("key", KEYS), ("password", PASSWORDS), ("pem", ("-----begin ",))):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    moved = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """The account identifier that a cue ending at ``at`` introduces."""
    start = GAP.match(text, at).end()
    if m := IBAN.match(text, start):
        # The longest prefix with a right checksum: what follows may look like more of it.
        for stop in range(m.end(), start + 14, -1):
            if text[stop - 1] != " " and iban_valid(text[start:stop].replace(" ", "")):
                return start, stop
    m = NUMBER.match(text, start)
    return m and m.span()


def spread(text: str) -> float:
    """Shannon entropy of a text's characters, in bits."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def secret_at(text: str, at: int, kind: str) -> tuple[int, int] | None:
    """The credential that is assigned to a cue ending at ``at``."""
    gap = ASSIGNED.match(text, at)
    m = gap and (PASSWORD if kind == "password" else KEY).match(text, gap.end())
    if m is None:
        return None
    found = m[0].rstrip(".")
    mixed = any(c.isdigit() for c in found) and any(c.isalpha() for c in found)
    least = (8, 2.5) if kind == "password" else (16, 3.0)
    return (m.start(), m.start() + len(found)) if mixed and len(found) >= least[0] and spread(found) >= least[1] else None


def lowered(text: str) -> str:
    """The text in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind and start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return []
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may start
    for last, (kind, size) in anchors.iter(lowered(text)):
        at = last - size + 1
        if kind.isdigit():
            if at >= free["ip"]:
                if m := IP.match(text, at):
                    free["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                else:
                    free["ip"] = RUN.match(text, at).end()
            if at >= free["card"]:
                if m := CARD.match(text, at):
                    free["card"] = m.end()
                    digits = digits_of(m[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif kind == "@":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                free["email"] = m.end()
        elif kind == "+":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                free["phone"] = m.end()
                if 8 <= len(digits_of(m[0])) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            if at >= free["url"] and (at == 0 or not text[at - 1].isalnum()) and (m := URL.match(text, last + 1)):
                stop = m.end()
                while stop > last + 1 and text[stop - 1] in ".,;:!?)]}":
                    stop -= 1
                if stop > last + 1:
                    found["url"].append((at, stop))
                    free["url"] = stop
        elif kind == "pem":
            if at >= free["secret"] and (m := PEM.match(text, at)):
                found["secret"].append(m.span())
                free["secret"] = m.end()
        elif kind in ("key", "password"):
            # A cue may be the last part of a name, as in access_token or apiKey.
            whole = at == 0 or not text[at - 1].isalnum() or text[at].isupper() and text[at - 1].islower()
            if whole and (s := secret_at(text, last + 1, kind)) and s[0] >= free["secret"]:
                found["secret"].append(s)
                free["secret"] = s[1]
        elif (at == 0 or not text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalnum() and (s := account_at(text, last + 1)) and s[0] >= free["account"]:
            found["account"].append(s)
            free["account"] = s[1]
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def masked(text: str | None, parts: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the leftmost, longest one counts."""
    if not parts:
        return text
    out, done = [], 0
    for kind, a, b in sorted(parts, key=lambda p: (p[1], -p[2], p[0])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
            done = b
        elif b > done:  # the tail of an overlap goes too
            done = b
    return "".join([*out, text[done:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """(id, spans [, masked text]) of every row; ``spans`` is array<struct<kind, start, end>>."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        anchors = automaton()

        def work(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            rows = [spans(t, anchors) for t in texts]
            columns = [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], arrow)]
            if mask:
                columns.append(pa.array([masked(t, r) for t, r in zip(texts, rows, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "spans", "masked"][: len(columns)])

        return work

    return map_batches(docs.select(id_col, text_col), fields(docs, id_col, "spans array<struct<kind: string, start: long, end: long>>" + ", masked string" * mask), make)
