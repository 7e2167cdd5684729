"""Surrogates for personal data: detected entities get keyed replacements of the same type and format.

1. One pass finds entities, and in a text with names a second scan their bare mentions and parts; only documents that hold some are kept aside with their texts, so other texts never move.
2. Distinct entities (kind, normal form) get a candidate each from a keyed hash (HMAC-SHA-256), in the entity's own
   format: digits for digits, letters for letters of their script (any of Unicode's) and case, a name of the same gender and script.
3. Collision checks: a candidate that equals another entity of the data, or that another entity already holds, is
   drawn again with the next attempt number, until all are distinct.  Equal entities share one normal form, so that
   references stay together over all documents; distinct ones stay distinct.
4. The mapping goes back to the documents that need it, and texts are rewritten by spans.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, discard, table

#: Given names by gender and script, and family names by script; any other name keeps its script.
GIVEN = {
    ("latin", "f"): "Alice Anna Beatriz Carmen Chloe Clara Elena Emma Fatima Greta Hannah Ines Isabel Julia Karin Laura Lucia Maria Marta Nadia Nora Olivia Paula Rosa Sara Sofia Teresa Ursula Vera Zoe".split(),
    ("latin", "m"): "Adam Alberto Bruno Carlos Daniel David Emil Felix Georg Hugo Ivan James Javier Jonas Jose Karl Leo Luis Marco Martin Nils Oscar Pablo Paul Peter Rafael Simon Thomas Victor Walter".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
FAMILY = {
    "latin": "Abbott Bauer Castro Dubois Esposito Fischer Garcia Hansen Ibarra Jensen Keller Lambert Moreau Navarro Ortega Parker Quinn Richter Salas Thorne Urban Vidal Weber Young Zamora".split(),
    "cyrillic": "Белов Волков Громов Егоров Зайцев Козлов Лебедев Морозов Новиков Соколов".split(),
}
#: Forms of address and phrases before a name, with the gender they tell.
TITLES = {"mr": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "madame": "f", "mme": "f", "dr": "", "prof": "", "my name is": "", "mi nombre es": "", "je m'appelle": "", "mein name ist": "", "contact": "", "signed": ""}
_NAME = r"(?-i:[^\W\d_a-zß-ÿа-я][^\W\d_]+(?:[-'’][^\W\d_]+)?)"
KINDS = ["email", "card", "iban", "phone", "ssn", "ip", "access_key", "secret", "name"]
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<access_key>(?<![A-Za-z0-9])(?-i:AKIA|ASIA)(?-i:[0-9A-Z]{16})(?![A-Za-z0-9])|(?<!\w)(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9-]{16,})"
    r"|(?:\b(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key)\b[\"']?\s*[:=]\s*[\"']?(?P<secret>[A-Za-z0-9+/_=-]{8,}))"
    r"|(?P<iban>(?<!\w)(?-i:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?:\d{1,3})?(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]))"
    r"|(?:\b(?P<title>" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r")\b[.:]?[ ](?P<name>" + _NAME + r"(?: " + _NAME + r"){0,2}))",
    re.IGNORECASE,
)
_DIGITS = re.compile(r"\d")
#: Scripts written without blanks between words: names in them are found inside runs of letters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
#: What every entity holds at least: a digit or @, the head of a key, a secret's label, or a title and a blank.  Most texts hold none of
#: these, and testing them takes a small part of the time that the pattern takes.
_DIGIT_OR_AT = re.compile(r"[\d@]")
_HEADS = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")
_LABELS = ("pass", "pwd", "token", "secret", "api")
_LABEL = re.compile(r"\b(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key)\b[\"']?\s*[:=]")
_TITLED = [t + end for t in TITLES for end in (" ", ". ", ": ")]
_TITLE = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r")\b[.:]? ")


def _script(text: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", text) else "latin" if re.search("[A-Za-zÀ-ɏ]", text) else "other"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def normal(kind: str, surface: str, title: str = "") -> str:
    """The form that all ways of writing one entity share."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", surface)
    if kind == "phone":
        digits = re.sub(r"\D", "", surface)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "email":
        return surface.lower()
    if kind == "name":
        return " ".join(surface.lower().split())
    return surface


def possible(text: str) -> bool:
    """False only for texts without entities."""
    if _DIGIT_OR_AT.search(text):
        return True
    folded = text.casefold()
    return any(h in folded for h in _HEADS) or (any(x in folded for x in _LABELS) and _LABEL.search(folded) is not None) or (any(t in folded for t in _TITLED) and _TITLE.search(folded) is not None)


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """start, end, kind, normal form and hint (a name's gender, if told) of each entity, in order."""
    out = []
    for m in PATTERN.finditer(text) if possible(text) else ():
        kind = m.lastgroup if m.lastgroup != "title" else "name"
        surface = m[kind]
        digits = sum(map(str.isdigit, surface)) if kind in ("phone", "card") else 0
        if kind == "phone" and not 7 <= digits <= 15 or kind == "card" and not 13 <= digits <= 19 or kind == "secret" and not any(map(str.isalnum, surface)):
            continue
        if kind == "name" and re.search("\\w['’][sS]$", surface):
            surface = surface[:-2]
        hint = TITLES[m["title"].lower()] if kind == "name" else ""
        out.append((m.start(kind), m.start(kind) + len(surface), kind, normal(kind, surface), hint))
    return out


def _places(words: list[str], within: list[str]) -> list[int]:
    """Places of ``words`` in a longer name, in order; none if they aren't all in it."""
    out, at = [], 0
    for w in words:
        if w not in within[at:]:
            return []
        at = within.index(w, at) + 1
        out.append(at - 1)
    return out


def references(text: str) -> list[tuple[int, int, str, str, str, list[int]]]:
    """The entities of a text, and bare mentions of its names and their parts, in order.

    A name that is part of a longer one of the text (Smith, of John Smith) is that person's: it bears the longer name
    and, last, the places of its words in it; of several such persons the last named before is meant, or else the first
    named after, of the gender told if one is.  All else has no places and stands for itself.
    """
    found = entities(text)
    hints, starts, by_word, surfaces = {}, {}, {}, set()
    for start, end, kind, name, hint in found:
        if kind == "name":
            hints[name] = max(hint, hints.get(name, ""))
            starts.setdefault(name, []).append(start)
            surfaces.update(text[start:end].split())
    if not hints:
        return [(*f, []) for f in found]
    for name in hints:
        for w in set(name.split()):
            by_word.setdefault(w, []).append(name)

    def longer(name: str, hint: str) -> Iterator[tuple[str, list[int]]]:
        words = name.split()
        for other in by_word.get(words[0], ()):
            within = other.split()
            if len(within) > len(words) and not (hint and hints[other] and hint != hints[other]) and (places := _places(words, within)):
                yield other, places

    whole = {name for name in hints if next(longer(name, hints[name]), None) is None}

    def meant(name: str, hint: str, at: int) -> tuple[str, list[int]]:
        def rank(x: tuple[str, list[int]]) -> tuple[bool, int]:
            before = [s for s in starts[x[0]] if s <= at]
            return (True, before[-1]) if before else (False, -starts[x[0]][0])

        return max((x for x in longer(name, hint) if x[0] in whole), key=rank, default=(name, []))

    out = [(start, end, kind, *((meant(name, hint, start)[0], hint, meant(name, hint, start)[1]) if kind == "name" else (name, hint, []))) for start, end, kind, name, hint in found]
    # A longer name's gender goes with its own mentions only.
    out = [(*x[:4], "" if x[5] else x[4], x[5]) for x in out]
    known = sorted({*hints, *(w for w in by_word if len(w) > 1 or _UNSPACED.match(w))}, key=lambda x: (-len(x), x))
    bound = lambda x: (r"(?<!\w)" if not _UNSPACED.match(x[0]) else "") + r"\s+".join(map(re.escape, x.split())) + (r"(?!\w)" if not _UNSPACED.match(x[-1]) else "")
    at = 0
    held = sorted((x[0], x[1]) for x in out)
    for m in re.compile("|".join(map(bound, known)), re.IGNORECASE).finditer(text):
        while at < len(held) and held[at][1] <= m.start():
            at += 1
        if at < len(held) and held[at][0] < m.end() or m[0][0].islower() and m[0].split()[0] not in surfaces:
            continue
        name = normal("name", m[0])
        person, places = (name, []) if name in whole else meant(name, "", m.start())
        if places or person in hints:
            out.append((m.start(), m.end(), "name", person, "", places))
    return sorted(out, key=lambda x: x[:2])


@cache
def letters_like(c: str) -> str:
    """Letters of a letter's script and case, in lower case if it has two: those near it in Unicode, of its category."""
    if "Ѐ" <= c <= "ӿ":
        return "абвгдежзиклмнопрстуфхцчшэюя"
    if c <= "ɏ":
        return "abcdefghijklmnopqrstuvwxyz"
    c = c.lower() if len(c.lower()) == 1 else c
    script = lambda x: unicodedata.name(x, "").split(" ")[0]
    block = map(chr, range(ord(c) & ~0xFF, (ord(c) | 0xFF) + 1))
    # Composed and compatibility forms are left out, and letters that don't come back from their upper case.
    return "".join(x for x in block if x.isalpha() and unicodedata.category(x) == unicodedata.category(c) and script(x) == script(c) and unicodedata.normalize("NFKD", x) == x and x.upper().lower() == x) or c


class Draw:
    """Numbers from a keyed hash of an entity and an attempt."""

    def __init__(self, key: bytes, *what: str | int):
        self.key, self.seed, self.n, self.left = key, "\0".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left = hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), "sha256").digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % n

    def like(self, text: str) -> str:
        """Digits for digits, letters of the same script and case for letters, hexadecimal for hexadecimal."""
        hexa = re.fullmatch(r"[0-9a-f]{8,}", text) and re.search(r"\d", text) and re.search("[a-f]", text)
        out = []
        for c in text:
            if hexa:
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letters = letters_like(c)
                x = letters[self.below(len(letters))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, name: str, hint: str, attempt: int) -> str:
    """A candidate for an entity's normal form; later attempts give other ones.

    Every format has finitely many values, some a single one: attempts after the fourth are longer and keep growing, so
    there is always room for one entity more.  An address (ip) can't grow and gets one of version 6.
    """
    draw = Draw(key, kind, name, attempt)
    longer = 4 + attempt // 4 if attempt > 3 else 0
    own = next((c for c in reversed(name.partition("@")[0]) if c.isalpha()), "a")
    if kind == "email":
        local, _, domain = name.partition("@")
        labels = domain.split(".")
        return draw.like(local) + draw.like(own * longer) + "@" + ".".join([draw.like(labels[0]), *labels[1:]])
    if kind == "ip" and longer:
        return "2001:db8:" + ":".join(f"{draw.below(1 << 16):04x}" for _ in range(6))
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = name[0] + draw.like(name[1:-1] + "0" * longer)
        last = [str(d) for d in range(10) if luhn(body + str(d))][0]
        return body + (last if luhn(name) else str((int(last) + 1 + draw.below(9)) % 10))
    if kind in ("phone", "ssn"):
        return "".join(str(2 + draw.below(8)) if i == 0 else str(draw.below(10)) for i in range(len(name) + longer))
    if kind == "iban":
        return name[:2] + draw.like(name[2:] + "0" * longer)
    if kind == "access_key":
        head = re.match(r"[A-Za-z]+[_-]?(?=[A-Za-z0-9-]{16})", name)
        cut = 4 if name[:4] in ("AKIA", "ASIA") else head.end() if head else 0
        return name[:cut] + draw.like(name[cut:]) + draw.like("a" * longer)
    if kind == "name":
        script = _script(name)
        if script not in FAMILY:
            return draw.like(name) + draw.like(own * longer)
        parts = name.split(" ")
        gender = hint or next((g for (s, g), names in GIVEN.items() if s == script and parts[0].capitalize() in names), "mf"[draw.below(2)])
        pick = lambda names: names[draw.below(len(names))].lower()
        out = [pick(GIVEN[script, gender]) if len(parts) > 1 else pick(FAMILY[script]), *(pick(FAMILY[script]) for _ in parts[1:])]
        if longer:
            out[-1] += "-" + draw.like(own * longer)
        return " ".join(out)
    return draw.like(name) + draw.like("a" * longer)


def rendered(kind: str, surface: str, fake: str) -> str:
    """The surrogate in the surface form's own separators and case."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(fake)
        skip = len(_DIGITS.findall(surface)) - len(fake)
        out = []
        for c in surface:
            if c.isdigit() and skip > 0:
                skip -= 1
            elif c.isdigit():
                c = next(digits, c)
            out.append(c)
        return "".join([*out, *digits])
    if kind == "iban":
        letters = iter(fake)
        return "".join([*(c if c == " " else next(letters, c) for c in surface), *letters])
    if kind == "name":
        words, gaps = surface.split(), re.findall(r"\s+", surface)
        out = [w.upper() if s.isupper() and len(s) > 1 else "-".join(p.capitalize() for p in w.split("-")) if s[:1].isupper() else w for s, w in zip(words + [words[-1]] * 9, fake.split(" "), strict=False)]
        return "".join(x for pair in zip(out, [*gaps, *[" "] * len(out)][: len(out) - 1] + [""], strict=True) for x in pair)
    if kind == "email" and surface.isupper():
        return fake.upper()
    return fake


_FOUND = "doc_id long, text string, spans array<struct<start:int,end:int,kind:string,name:string,hint:string,places:array<int>>>"


def detected(docs: DataFrame, held: bool) -> DataFrame:
    """doc_id, text, spans of the documents with entities, or (``held`` false) those of the documents without, spans null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("hint", pa.string()), ("places", pa.list_(pa.int32()))]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, spans = [], []
                for i, text in enumerate(part.column(1)):
                    found = references(text.as_py() or "") if held else entities(text.as_py() or "")
                    if bool(found) == held:
                        rows.append(i)
                        spans.append([dict(zip(("start", "end", "kind", "name", "hint", "places"), f, strict=True)) for f in found] if held else None)
                where = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


def mapping(found: DataFrame, key: bytes) -> DataFrame:
    """kind, name and fake: a surrogate for each distinct entity, distinct within its kind and none of the entities."""

    def candidates(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, names, hints = (c.to_pylist() for c in batch.columns)
                fakes = [surrogate(key, *x, attempt) for x in zip(kinds, names, hints, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fakes, pa.string())], ["kind", "name", "hint", "fake"])

        return run

    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.name", "s.hint")
    todo = everything = checkpointed(spans.groupBy("kind", "name").agg(F.max("hint").alias("hint")))
    taken = everything.select("kind", F.col("name").alias("fake"))
    settled: list[DataFrame] = []
    attempt = 0
    while not todo.isEmpty():
        drawn = todo.select("kind", "name", "hint").mapInArrow(candidates(attempt), "kind string, name string, hint string, fake string")
        drawn = checkpointed(drawn)
        free = drawn
        for held in (taken, *(s.select("kind", "fake") for s in settled)):
            free = free.join(held.hint("merge"), ["kind", "fake"], "left_anti")
        settled.append(checkpointed(free.groupBy("kind", "fake").agg(F.min("name").alias("name"))))
        rest = checkpointed(todo.join(settled[-1].select("kind", "name").hint("merge"), ["kind", "name"], "left_anti"))
        discard(drawn)
        todo, attempt = rest, attempt + 1
    named = [s.select("kind", "name", "fake") for s in settled] or [taken.select("kind", F.col("fake").alias("name"), "fake")]
    return reduce(DataFrame.union, named)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text with surrogates, n_entities, kinds (counts by kind).

    The same key gives the same surrogates wherever they don't collide.  A document without entities comes back
    unchanged with n_entities 0; a null text stays null.  Repeated rows give repeated results, a null doc_id stays
    null, other columns are ignored and an empty table gives an empty result.
    """
    found = checkpointed(detected(docs, True).withColumn("row_key", F.xxhash64("doc_id", "text")))
    names = mapping(found, key.encode())
    # One row an entity and document; the entity that half the documents hold meets its surrogate in a join that
    # adaptive execution splits.
    wanted = found.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("owner"), "row_key", F.explode("spans").alias("s")).select("owner", "row_key", "s.kind", "s.name").distinct()
    pairs = wanted.join(names.hint("merge"), ["kind", "name"]).groupBy("owner", "row_key").agg(F.collect_list(F.struct("kind", "name", "fake")).alias("fakes"))
    pairs = pairs.select("owner", F.col("row_key").alias("key_"), "fakes")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = []
                for text, spans, fakes in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    by, out, at = {(f["kind"], f["name"]): f["fake"] for f in fakes}, [], 0
                    for s in spans:
                        fake = by[s["kind"], s["name"]]
                        if s["places"]:
                            words = fake.split(" ")
                            fake = " ".join(words[i] for i in s["places"])
                        out += [text[at : s["start"]], rendered(s["kind"], text[s["start"] : s["end"]], fake)]
                        at = s["end"]
                    texts.append("".join([*out, text[at:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(2)], ["doc_id", "text", "spans"])

    joined = found.join(pairs.hint("merge"), (F.coalesce(found["doc_id"], F.lit(-(1 << 63))) == pairs["owner"]) & (found["row_key"] == pairs["key_"]))
    changed = joined.select(found["doc_id"], "text", "spans", "fakes").mapInArrow(rewrite, _FOUND)
    out = changed.union(detected(docs, False))
    count = lambda k: F.size(F.filter(F.coalesce("spans", F.array()), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_entities"), *(count(k) for k in KINDS))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"), "surrogates of the op6 query")
