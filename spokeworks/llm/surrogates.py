"""Personal data and secrets replaced by surrogates of the same type and format.

A surrogate is drawn by a keyed hash of the entity, so equal entities have
equal surrogates in every document and run, and nobody without the key can
tell one from the other. Digits stay digits, letters letters of the same case,
separators stay; checksums that held hold again; names keep gender and script.
The gender of a given name that isn't a common one is what all its titles agree
on, over the whole corpus, so a person is one whatever title stands before.
Two entities never share a surrogate, and none is an entity of the corpus:
entities that collide draw again until none does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.batches import slices
from spokeworks.operators.staging import stage

KNOWN_ROWS = 100_000  # affected rows that are broadcast; more are joined by a shuffle
ROUNDS = 64  # draws before the collision check gives up with an error

# fixed values: titles, and common given names by gender and script
MALE_TITLES = "Mr Mister Sir Herr Monsieur Señor Don Господин".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita Doña Госпожа".split()
OTHER_TITLES = "Dr Prof Professor".split()
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew "
    "Paul Mark Peter Hans Klaus Jürgen Pierre Jean Jacques Carlos José Juan".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa "
    "Emma Anna Laura Ursula Monika Petra Marie Sophie Camille María Carmen Lucía".split(),
    ("m", "cyrillic"): "Александр Дмитрий Иван Сергей Николай Михаил Павел Алексей".split(),
    ("f", "cyrillic"): "Анна Елена Мария Ольга Наталья Татьяна Ирина Светлана".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бо ва во га да до жа за ка ко ла ло ма мо на но па по ра ро са со та то ха".split(),
}

_NAMES = {name: kind for kind, names in GIVEN.items() for name in names}
_TITLES = [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]
_TRIGGERS = {*_TITLES, *_NAMES}
_WORD = re.compile(r"\w+")  # a title or given name of _PERSON is one such run as a whole
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]+"
_PERSON = re.compile(
    rf"\b(?:(?P<title>{'|'.join(_TITLES)})\.?[ \t]+(?:(?P<own>{_CAPITAL})[ \t]+)?(?P<family>{_CAPITAL})"
    rf"|(?P<given>{'|'.join(_NAMES)})[ \t]+(?P<last>{_CAPITAL}))"
)
_EMAIL = re.compile(r"(?<![\w.+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.ASCII)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET = r"(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z]{20,})"
_NUMBERED = re.compile(
    r"(?<![\w@])(?:"
    rf"(?P<secret>{_SECRET})(?!\w)"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    rf"|(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))",
    re.ASCII,
)
_DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class Entity:
    """A place in a text, and what is found there: equal entities have equal kind and norm."""

    start: int
    end: int
    kind: str
    norm: str
    gender: str = "n"  # what a title says of a given name that isn't a common one


def script(name: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", name) else "latin"


def find(text: str) -> list[Entity]:
    """The entities of a text, in order, without overlaps; the earlier of two kinds counts.

    Full names are found by a title or a common given name; a family name found
    so counts wherever else it stands in the text as a word.
    """
    found: list[Entity] = []
    if "@" in text:
        found += (Entity(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text))
    if _DIGIT.search(text):
        for m in _NUMBERED.finditer(text):
            kind = m.lastgroup
            norm = m[0].lower() if kind in ("secret", "ip") else re.sub(r"[^0-9a-z]", "", m[0].lower())
            norm = "+" * m[0].startswith("+") + norm
            found.append(Entity(*m.span(), kind, norm))
    if not _TRIGGERS.isdisjoint(_WORD.findall(text)):
        families: dict[str, str] = {}
        for m in _PERSON.finditer(text):
            title, own, family = m["title"], m["own"] or m["given"], m["family"] or m["last"]
            gender = "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else "n"
            if own:
                group = "given" if m["given"] else "own"
                kind = f"given-{_NAMES[own][0]}-{script(own)}" if own in _NAMES else f"given-{script(own)}"
                found.append(Entity(*m.span(group), kind, own.lower(), gender))
            families[family] = f"family-{script(family)}"
            group = "family" if m["family"] else "last"
            found.append(Entity(*m.span(group), families[family], family.lower()))
        for family, kind in families.items():
            for m in re.finditer(rf"\b{re.escape(family)}\b", text):
                found.append(Entity(*m.span(), kind, family.lower()))
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _draws(key: bytes, kind: str, norm: str, attempt: int) -> Iterator[int]:
    """An endless row of numbers below 2^32 that the key and the entity determine."""
    block = 0
    while True:
        text = f"{kind}\0{norm}\0{attempt}\0{block}".encode()
        digest = hashlib.blake2b(text, key=key, digest_size=64).digest()
        yield from (int.from_bytes(digest[i : i + 4], "little") for i in range(0, 64, 4))
        block += 1


def _like(chars: str, draws: Iterator[int], letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Digits for digits, letters for letters, everything else as it is."""
    return "".join(
        str(next(draws) % 10) if c.isdigit() else letters[next(draws) % len(letters)] if c.isalpha() else c for c in chars
    )


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


#: Endings of family names that women bear with one letter more: the letter goes for the draw.
_FEMININE = ("ова", "ева", "ёва", "ина", "ына")


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0, gender: str = "n") -> str:
    """What the entity becomes, in normal form; of equal length but for names."""
    feminine = kind == "family-cyrillic" and norm.endswith(_FEMININE)
    if feminine:  # drawn as the masculine form is, so that a couple keeps one name
        norm = norm[:-1]
    draws = _draws(key, kind, norm, attempt)
    if kind == "secret":
        head = re.match(r"akia|gh[pousr]_|sk-", norm)
        head = head[0] if head else ""
        letters = "abcdef" if not head else "abcdefghijklmnopqrstuvwxyz"
        return head + _like(norm[len(head) :], draws, letters)
    if kind == "ip":
        bounds = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        if attempt > ROUNDS // 2:  # few addresses have so short parts
            bounds = {n: (0, 256) for n in bounds}
        return ".".join(str(lo + next(draws) % (hi - lo)) for lo, hi in (bounds[len(x)] for x in norm.split(".")))
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2] == "example" else 1  # names reserved for examples stay
        return ".".join([_like(local, draws) + "@" + ".".join(_like(x, draws) for x in labels[:-kept]), *labels[-kept:]]).replace("@.", "@")
    if kind == "card":
        body = norm[0] + _like(norm[1:-1], draws)
        if luhn(norm):
            return next(body + d for d in "0123456789" if luhn(body + d))
        return body + _like(norm[-1], draws)
    if kind == "iban":
        body = _like(norm[4:], draws)
        number = "".join(str(int(c, 36)) for c in body + norm[:2] + "00")
        return f"{norm[:2]}{98 - int(number) % 97:02d}{body}"
    if kind in ("phone", "ssn"):
        kept = 2 if norm[0] == "+" else 0  # the country stays, or its group of countries
        return norm[:kept] + _like(norm[kept:], draws)
    role, *listed, writing = kind.split("-")
    if listed:  # the common names of a gender in an order that the key gives; each becomes the next one
        names = [n.lower() for n in GIVEN[listed[0], writing]]
        names.sort(key=lambda n: (next(_draws(key, kind, n, 0)), n))
        return names[(names.index(norm) + 1) % len(names)]
    parts = SYLLABLES[writing]
    end = {"latin": "na", "cyrillic": "на"}[writing] if role == "given" and gender == "f" else ""
    if role == "family" and writing == "cyrillic" and (feminine or norm.endswith(tuple(x[:-1] for x in _FEMININE))):
        end = "ова" if feminine else "ов"
    return "".join(parts[next(draws) % len(parts)] for _ in range(3 + attempt // 8)) + end


def rendered(original: str, kind: str, value: str) -> str:
    """A surrogate in the case and with the separators of the original."""
    if kind.startswith(("given", "family")):
        if original.isupper() and len(original) > 1:
            return value.upper()
        return value[:1].upper() + value[1:] if original[:1].isupper() else value
    if kind in ("ip", "email", "secret"):
        chars = iter(value)
        same = len(value) == len(original)
        return "".join(c.upper() if o.isupper() else c for c, o in zip(chars, original, strict=True)) if same else value
    chars = iter(value.removeprefix("+"))
    return "".join((next(chars).upper() if c.isupper() else next(chars)) if c.isalnum() else c for c in original)


def replace(text: str, key: bytes, known: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of what was replaced.

    ``known`` has the draw and the gender of entities where these aren't the first and none.
    """
    out, at, kinds = [], 0, []
    for e in find(text):
        value = surrogate(key, e.kind, e.norm, *known.get((e.kind, e.norm), (0, "n")))
        out += [text[at : e.start], rendered(text[e.start : e.end], e.kind, value)]
        at = e.end
        kinds.append(e.kind.split("-")[0])
    return "".join([*out, text[at:]]), kinds


def entities(docs: DataFrame) -> DataFrame:
    """``kind, norm, gender``: the distinct entities of all texts; a gender on which mentions differ is none."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = {(e.kind, e.norm, e.gender) for t in batch.column("text").to_pylist() if t for e in find(t)}
            columns = list(zip(*sorted(found), strict=True)) if found else [()] * 3
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["kind", "norm", "gender"])

    said = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "kind string, norm string, gender string")
    men, women = F.bool_or(F.col("gender") == "m"), F.bool_or(F.col("gender") == "f")
    gender = F.when(men & ~women, "m").when(women & ~men, "f").otherwise("n")
    return said.groupBy("kind", "norm").agg(gender.alias("gender"))


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Adds ``surrogate`` to ``kind, norm, attempt, gender``."""
    names = ["kind", "norm", "attempt", "gender"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [surrogate(key, *row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(values, pa.string())], names=[*names, "surrogate"])

    schema = "kind string, norm string, attempt int, gender string, surrogate string"
    return rows.select(*names).mapInArrow(task, schema)


def drawn(found: DataFrame, key: bytes, draw: Callable[[DataFrame, bytes], DataFrame] = _drawn) -> DataFrame:
    """``kind, norm, attempt, gender, surrogate``: no surrogate is used twice, or is an entity itself.

    Of entities with one surrogate the first by norm keeps it, all others draw
    again. Common given names are exempt: they change places with each other.
    """
    found = stage(found, "pii-entities")
    now = stage(draw(found.withColumn("attempt", F.lit(0)), key), "pii-drawn")
    for _ in range(ROUNDS):
        first = now.groupBy("kind", "surrogate").agg(F.min("norm").alias("first"), F.count("*").alias("n"))
        taken = first.where("n > 1").join(now, ["kind", "surrogate"]).where("norm <> first").select("kind", "norm")
        real = now.join(found.withColumnRenamed("norm", "surrogate"), ["kind", "surrogate"], "left_semi")
        real = real.where("NOT kind LIKE 'given-_-%'").select("kind", "norm")
        again = stage(taken.unionByName(real).distinct(), "pii-again")
        if again.isEmpty():
            return now
        more = now.join(again, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = stage(now.join(again, ["kind", "norm"], "left_anti").unionByName(draw(more, key)), "pii-drawn")
    raise ValueError(f"entities still collide after {ROUNDS} draws")


def _with_attempts(docs: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Adds ``_attempts`` to rows whose texts hold an entity of ``redrawn``."""
    if redrawn.isEmpty():
        none = F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int,gender:string>>")
        return docs.withColumn("_attempts", none)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes = batch.column("h").to_pylist()
            rows = {(h, e.kind, e.norm) for h, t in zip(hashes, batch.column("text").to_pylist(), strict=True) for e in find(t)}
            h, kind, norm = zip(*sorted(rows), strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [pa.array(h, pa.int64()), pa.array(kind, pa.string()), pa.array(norm, pa.string())], names=["_h", "kind", "norm"]
            )

    text = F.col("text").cast("string")
    uses = (
        docs.select(text.alias("text"), F.xxhash64(text).alias("h"))
        .where("text IS NOT NULL")
        .mapInArrow(task, "_h bigint, kind string, norm string")
        .distinct()
        .join(redrawn, ["kind", "norm"])
        .groupBy("_h")
        .agg(F.collect_list(F.struct("kind", "norm", "attempt", "gender")).alias("_attempts"))
    )
    uses = stage(uses, "pii-uses")
    if (uses.agg(F.sum(F.size("_attempts")).alias("n")).first()["n"] or 0) <= KNOWN_ROWS:
        uses = F.broadcast(uses)
    return docs.join(uses, F.xxhash64(text) == F.col("_h"), "left")


def anonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, kinds`` of each row: the text with surrogates, and the kinds replaced, in order.

    Null text stays null, other text keeps everything but its entities. Rows
    with equal or null ids are treated row by row, alike if their texts are.
    Other columns are ignored; an empty table stays empty. Long texts are
    searched as a whole.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    redrawn = drawn(entities(own), key).where("attempt > 0 OR gender = 'f'").select("kind", "norm", "attempt", "gender")
    redrawn = stage(redrawn, "pii-redrawn")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, kinds = [], []
            for text, given in zip(batch.column("text").to_pylist(), batch.column("_attempts").to_pylist(), strict=True):
                known = {(a["kind"], a["norm"]): (a["attempt"], a["gender"]) for a in given or []}
                new, own_kinds = (None, []) if text is None else replace(text, key, known)
                texts.append(new)
                kinds.append(own_kinds)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))],
                names=["doc_id", "text", "kinds"],
            )

    return _with_attempts(own, redrawn).select("doc_id", "text", "_attempts").mapInArrow(
        task, "doc_id bigint, text string, kinds array<string>"
    )
