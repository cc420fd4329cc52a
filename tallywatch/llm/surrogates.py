"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same at every mention.

Numbers, addresses and mail names go through keyed permutations of all values of their format (a Feistel network
with cycle walking), so different values of one format cannot meet. Names are drawn by keyed hash from lists of the
same gender and script. All distinct entities of the corpus are then checked in grouped aggregations: an entity
whose surrogate belongs to another one too, or is itself an entity of the corpus, draws again until none does. Each
draw of a name takes a longer one, so that names do not run out.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, materialize, on_workers

KINDS = ("email", "ip", "phone", "ssn", "card", "iban", "name")
_ENTITY = re.compile(r"""
    (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
  | (?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)
      |(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w))
  | (?P<card>(?<![\w-])\d{4}(?:[ -]?\d{4}){2}(?:[ -]?\d{1,7})(?![\w-]*\w)|(?<![\w-])\d{13,19}(?!\w))
  | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
""", re.VERBOSE | re.ASCII)
_CAPITALISED = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+(?:[-'][^\W\d_]+)?"
# Forms of address by the gender they tell.
_TITLES = {
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "г-жа"),
    "x": ("Dr", "Prof", "Professor"),
}
_GENDER = {title: gender for gender, titles in _TITLES.items() for title in titles}
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, _GENDER), key=len, reverse=True))})\.?[ ]({_CAPITALISED}(?:[ ]{_CAPITALISED})?)")
# Given names by script and gender, and the syllables of surnames by script.
_GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Pablo"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ольга"),
}
_SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "po", "ra", "re", "ro", "sa", "se", "so", "ta", "to"),
    "cyrillic": ("ба", "бо", "ва", "во", "га", "го", "да", "до", "за", "зо", "ка", "ко", "ла", "ло", "ма", "мо"),
}
_FOUND = "kind string, canonical string, style string"
_ENTITIES = _FOUND + ", attempt int, surrogate string"
_OUT = "doc_id long, text string, n_entities long, kinds string"


def _draw(key: bytes, *parts: object, bits: int = 128) -> int:
    """At least ``bits`` keyed random bits, the same for the same parts."""
    data = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    blocks = (hashlib.blake2b(data + (f"\0block {i}".encode() if i else b""), key=key, digest_size=16).digest() for i in range(-(-bits // 128)))
    return int.from_bytes(b"".join(blocks), "big")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: eight Feistel rounds, walked until the result is inside."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(8):
            left, right = right, left ^ (_draw(key, tweak, size, i, right, bits=half) & mask)
        value = left << half | right
        if value < size:
            return value


def _same_shape(text: str, key: bytes, tweak: str) -> str:
    """Letters for letters and digits for digits of a lower-case text; everything else stays."""
    radix = [26 if "a" <= c <= "z" else 10 if "0" <= c <= "9" else 1 for c in text]
    value, size = 0, 1
    for c, r in zip(text, radix, strict=True):
        if r > 1:
            value, size = value * r + ord(c) - ord("a" if r == 26 else "0"), size * r
    value = permute(value, size, key, tweak + re.sub("[0-9]", "0", re.sub("[a-z]", "a", text)))
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if r == 1:
            out.append(c)
        else:
            value, rest = divmod(value, r)
            out.append(chr(ord("a" if r == 26 else "0") + rest))
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def canonical(kind: str, text: str) -> str:
    """The form that all mentions of one entity share."""
    if kind == "phone":
        return re.sub("[^0-9]", "", text)[-10:]  # without the country code
    if kind in ("card", "ssn"):
        return re.sub("[^0-9]", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return str(ipaddress.IPv4Address(".".join(str(int(x)) for x in text.split("."))))
    return text.lower() if kind == "email" else text


def _ip_class(value: int) -> str:
    address = ipaddress.IPv4Address(value)
    return "private" if address.is_private else "special" if address.is_multicast or address.is_reserved else "public"


def _dialled(digits: str) -> bool:
    """Area code and exchange of a ten-digit number are possible ones."""
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def surrogate(kind: str, value: str, style: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity. ``style``: gender and script of a name, else empty."""
    tweak = f"{kind}/{attempt}/"
    if kind == "email":
        local, _, domain = value.partition("@")
        names, _, top = domain.rpartition(".")
        # The domain is an entity of its own: mail names of one domain keep one domain.
        return f"{_same_shape(local, key, tweak + domain)}@{_same_shape(names, key, f'domain/{attempt}/')}.{top}"
    if kind == "ip":
        number = int(ipaddress.IPv4Address(value))
        wanted, out = _ip_class(number), permute(number, 1 << 32, key, tweak)
        while _ip_class(out) != wanted:
            out = permute(out, 1 << 32, key, tweak)
        return str(ipaddress.IPv4Address(out))
    if kind == "phone":
        out = _same_shape(value, key, tweak)
        while _dialled(value) and not _dialled(out):
            out = _same_shape(out, key, tweak)
        return out
    if kind == "card":
        first, body, check = value[0], value[1:-1], value[-1]
        new = first + _same_shape(body, key, tweak + first)
        return new + str((_luhn(new) + int(check) - _luhn(first + body)) % 10)
    if kind == "iban":
        country, body = value[:2], _same_shape(value[4:].lower(), key, tweak + value[:2]).upper()
        number = int("".join(str(int(c, 36)) for c in body + country + "00"))
        return f"{country}{98 - number % 97:02d}{body}"
    if kind == "name":
        gender, script = style.split("/")
        *given, family = value.split(" ")
        syllables = _SYLLABLES[script]
        draw = _draw(key, "family", attempt, script, family, bits=8 * (4 + attempt))
        new = "".join(syllables[draw // len(syllables) ** i % len(syllables)] for i in range(4 + attempt)).capitalize()
        if not given:
            return new
        pool = _GIVEN[script, gender if gender != "x" else "mf"[_draw(key, "gender", value) % 2]]
        return f"{pool[_draw(key, 'given', attempt, script, gender, value) % len(pool)]} {new}"
    return _same_shape(value, key, tweak)


def _dressed(original: str, kind: str, new: str) -> str:
    """A canonical surrogate in the format of this mention: separators and letter case."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = list(new)
        return "".join(reversed([left.pop() if c.isalnum() and left else c for c in reversed(original)]))
    if kind == "email" and len(new) == len(original):
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new, strict=True))
    if kind == "name" and original.isupper():
        return new.upper()
    return new


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, style)`` of all mentions, in order and without overlaps."""
    found = []
    if "@" in text or re.search(r"\d", text):
        for m in _ENTITY.finditer(text):
            kind = m.lastgroup
            if kind == "card" and not 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                continue
            found.append((m.start(), m.end(), kind, ""))
    if any(title in text for title in _GENDER):
        for m in _NAME.finditer(text):
            script = "cyrillic" if re.search("[А-я]", m[2]) else "latin"
            found.append((m.start(2), m.end(2), "name", f"{_GENDER[m[1]]}/{script}"))
    found.sort()
    kept, upto = [], 0
    for mention in found:
        if mention[0] >= upto:
            kept.append(mention)
            upto = mention[1]
    return kept


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = set()
        for text in batch.column(0):
            text = text.as_py()
            seen.update((kind, canonical(kind, text[a:b]), style) for a, b, kind, style in entities(text))
        columns = list(zip(*sorted(seen), strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "canonical", "style"])


def _assign(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(r["kind"], r["canonical"], r["style"], key, r["attempt"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.string())], ["kind", "canonical", "style", "attempt", "surrogate"])
    return run


def assign_surrogates(found: DataFrame, key: bytes, *, rounds: int = 64) -> DataFrame:
    """``kind, canonical, style, attempt, surrogate`` of distinct entities, free of collisions.

    A surrogate shared by several entities stays with the smallest; the others, and any whose surrogate is an entity
    of the corpus, draw again. Each round writes its small result; the driver reads one count.
    """
    now = materialize(found.distinct().withColumn("attempt", F.lit(0)).mapInArrow(_assign(key), _ENTITIES), "surrogates")
    real = now.select("kind", F.col("canonical").alias("surrogate")).distinct()
    for _ in range(rounds):
        first = now.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        judged = now.join(first, ["kind", "surrogate"]).join(real.withColumn("is_real", F.lit(True)), ["kind", "surrogate"], "left")
        again = F.col("is_real").isNotNull() | (F.col("canonical") != F.col("first"))
        judged = judged.select("kind", "canonical", "style", "attempt", "surrogate", again.alias("again"))
        if not judged.filter("again").count():
            return now
        redrawn = judged.filter("again").select("kind", "canonical", "style", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_assign(key), _ENTITIES)
        now = materialize(judged.filter("not again").drop("again").unionByName(redrawn), "surrogates")
    raise ValueError(f"surrogates still collide after {rounds} rounds: a format has too few values")


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, redrawn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                attempts = {(r["kind"], r["canonical"], r["style"]): r["attempt"] for r in redrawn or ()}
                parts, upto, kinds = [], 0, []
                for a, b, kind, style in entities(text):
                    value = canonical(kind, text[a:b])
                    new = surrogate(kind, value, style, key, attempts.get((kind, value, style), 0))
                    parts += [text[upto:a], _dressed(text[a:b], kind, new)]
                    upto = b
                    kinds.append(kind)
                rows.append((doc_id, "".join(parts) + text[upto:], len(kinds), ",".join(kinds)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text", "n_entities", "kinds"])
    return run


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = set()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            seen.update((doc_id, kind, canonical(kind, text[a:b]), style) for a, b, kind, style in entities(text))
        columns = list(zip(*seen, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["doc_id", "kind", "canonical", "style"])


def replace_entities(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows: ``doc_id, text`` with surrogates, ``n_entities`` and their ``kinds`` in order.

    The same entity has the same surrogate in every document and format; different entities have different ones; no
    surrogate is an entity of the corpus. Texts without entities, blank and null ones (as empty texts) are returned as
    they are; repeated rows are rewritten each; no rows give no rows; other columns are ignored. An empty key is an error.
    """
    if not key:
        raise ValueError("surrogates need a key: without one anybody could link them to their originals")
    on_workers(docs.sparkSession)
    rows = documents(docs, id_col, text_col)
    table = assign_surrogates(rows.select("text").mapInArrow(_collect, _FOUND), key)
    redrawn = table.filter("attempt > 0").select("kind", "canonical", "style", "attempt")
    plain = "array<struct<kind:string,canonical:string,style:string,attempt:int>>"
    if redrawn.isEmpty():
        return rows.withColumn("redrawn", F.lit(None).cast(plain)).mapInArrow(_replace(key), _OUT)
    of_doc = rows.mapInArrow(_mentions, "doc_id long, kind string, canonical string, style string").join(
        redrawn, ["kind", "canonical", "style"]).groupBy(F.col("doc_id").alias("mention_id")).agg(
        F.collect_set(F.struct("kind", "canonical", "style", "attempt")).alias("redrawn"))
    of_doc = materialize(of_doc, "surrogates")
    joined = rows.join(of_doc, F.col("doc_id").eqNullSafe(F.col("mention_id")), "left").select("doc_id", "text", F.col("redrawn").cast(plain))
    return joined.mapInArrow(_replace(key), _OUT)
