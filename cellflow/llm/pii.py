"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus signs, digits, URL schemes and identifier cues; local
parsers then expand each anchor to both sides and validate what they find. Text without anchors is never parsed."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ship

#: The base kinds in the order that breaks ties of start, and then the kinds that cues add.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "iban", "secret", "handle"]
#: Fixed value: words before an account number, a key or a name.
CUES = ["iban", "IBAN", "token", "api_key", "apikey", "password", "passwd", "secret", "user:", "username"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9][0-9 .-]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[\s:=#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)")
_SECRET = re.compile(r"[\s:=]{1,4}[\"']?([A-Za-z0-9_\-+/]{16,})[\"']?")
_HANDLE = re.compile(r"[\s:=]{1,4}([A-Za-z][A-Za-z0-9_.-]{2,31})")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digits", 1))
    for word, kind in [("@", "email"), ("+", "phone"), ("://", "url"), *[(c, "cue") for c in CUES]]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def iban_ok(code: str) -> bool:
    """The ISO 13616 check: first four characters last, letters as numbers from 10, remainder 1 modulo 97."""
    s = code.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans_of(text: str, finder: ahocorasick.Automaton) -> list[Span]:
    """(start, end, kind) in code points by start, then kind. Base kinds are leftmost and don't overlap within their kind."""
    out: list[Span] = []
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    seen = 0  # end of the last run of digits
    for last, (kind, length) in finder.iter(text):
        at = last - length + 1
        if kind == "digits":
            if at < seen:
                continue
            run = _DIGITS.match(text, at)
            seen = run.end()
            piece = run.group()
            if piece.count(".") >= 3:
                out += [(at + m.start(), at + m.end(), "ip") for m in _IP.finditer(piece) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
            if len(piece) >= 12:
                for m in _CARD.finditer(piece):
                    digits = re.sub("[ -]", "", m.group())
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at + m.start(), at + m.end(), "card"))
        elif kind == "email":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end(), "email"))
                free["email"] = m.end()
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((at, m.end(), "phone"))
        elif kind == "url":
            start = at
            while start > free["url"] and (text[start - 1].isascii() and text[start - 1].isalnum()):
                start -= 1
            if start < at and (m := _URL.match(text, at)):
                end = at + len(m.group().rstrip(".,;:!?)"))
                out.append((start, end, "url"))
                free["url"] = end
        elif at >= max(free["iban"], free["secret"], free["handle"]):
            word = text[at : last + 1].lower()
            name, pattern = ("iban", _IBAN) if word == "iban" else ("handle", _HANDLE) if word.startswith("user") else ("secret", _SECRET)
            m = pattern.match(text, last + 1)
            if m and (name != "iban" or iban_ok(m.group(1))):
                out.append((m.start(1), m.end(1), name))
                free[name] = m.end(1)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (long), base_sha256, spans (all kinds, as kind:start:end).

    A null text is empty; without spans, spans is empty and base_sha256 that of the empty string. Repeated rows are searched one by one.
    """

    def search(texts: pd.Series) -> pd.DataFrame:
        finder, out = automaton(), []
        for t in texts:
            spans = spans_of(t, finder) if isinstance(t, str) and t else []
            base = [s for s in spans if s[2] in BASE]
            out.append((*(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(out, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    udf = F.pandas_udf(search, ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string", F.PandasUDFType.SCALAR)
    return pick(docs, doc_id="long", text="string").select("doc_id", udf("text").alias("p")).select("doc_id", "p.*")


ship(__name__)
