"""Surrogates for personal data and secrets.

Entities are found by pattern. Each gets a replacement of its own kind: same format character by
character, same network or private range, same check digit rule, same gender and script of a name.
The choice is drawn from a keyed hash of the entity, so it is the same in every document and can't be
turned back without the key. Draws are compared over the whole corpus: two entities never share a
surrogate and none equals a real entity; those that clash draw again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.common import fresh, map_batches, stored

# Draws in the entity's own format; each later one is a character longer, so a full format never blocks. An address
# leaves its private range for 10.0.0.0/8, then for any, and at last gets a port.
TRIES = 12

TITLES = {  # title -> gender
    **dict.fromkeys(["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "m"),
    **dict.fromkeys(["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], "f"),
    **dict.fromkeys(["Dr", "Prof"], "x"),
}
GIVEN = {
    ("LATIN", "m"): "Adam Bruno Carl Daniel Edgar Felix Gustav Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("LATIN", "f"): "Alice Berta Clara Diana Elena Flora Greta Helen Ida Julia Karin Laura Maria Nora Olga Paula".split(),
    ("CYRILLIC", "m"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Максим Олег Павел".split(),
    ("CYRILLIC", "f"): "Алла Белла Вера Галина Дарья Ева Жанна Ирина Ксения Лариса Мария Нина".split(),
    ("GREEK", "m"): "Άρης Γιώργος Δημήτρης Ηλίας Θάνος Κώστας Λάμπρος Νίκος Πέτρος Σπύρος".split(),
    ("GREEK", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Λίνα Μαρία Σοφία".split(),
}
SYLLABLES = {
    "LATIN": "bal cor den fal gar hol kar lan mor nel par ros sel tor val win".split(),
    "CYRILLIC": "бал вор ган дол зор кар лан мор нел пар рос сел тор фал".split(),
    "GREEK": "βαλ γορ δαν ζολ καρ λαν μορ νελ παρ ροσ σελ τορ φαλ".split(),
}

_WORD = r"[^\W\d_]"
NAME = rf"(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[ \t]+(?P<name>{_WORD}[\w'-]+(?:[ \t]+{_WORD}[\w'-]+){{0,2}})"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?(?P<secret>[^\s\"',;]{6,})"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<phone>(?<![\d(+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]))"
    rf"|\b(?:{NAME})"
)
# What a text with an entity has, told by Spark itself; other texts are passed on untouched.
HINT = r"[0-9@]|[=:]|\b(?:" + "|".join(TITLES) + r")\b"

Mention = tuple[int, int, str, str]  # start, end, kind, canonical form


def script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split(" ")[0]
    return name if name in SYLLABLES else "LATIN"


def digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def country_digits(text: str) -> int:
    """How many digits of a phone number are its country code, set off behind a plus."""
    code = re.match(r"\+(\d{1,3})\D", text)
    return len(code[1]) if code else 0


def canonical(kind: str, text: str) -> str:
    """One form for all spellings of an entity; a phone's country code is no part of it."""
    if kind == "phone":
        return digits(text)[country_digits(text) :]
    if kind in ("card", "ssn"):
        return digits(text)
    if kind == "email":
        return text.lower()
    return text.replace(" ", "") if kind == "iban" else text


def name_mentions(found: re.Match) -> list[Mention]:
    """Each word of a name is an entity of its own, so that a surname alone is still the same surname."""
    gender, at = TITLES[found["title"]], found.start("name")
    words = [(at + w.start(), w.group()) for w in re.finditer(r"\S+", found["name"])]
    keep = []
    for start, word in words:
        if not word[0].isupper():
            break
        keep.append((start, word))
    out = []
    for i, (start, word) in enumerate(keep):
        last = i == len(keep) - 1
        kind = f"surname:{script(word)}" if last else f"given:{script(word)}:{gender}"
        out.append((start, start + len(word), kind, word))
    return out


def mentions(text: str) -> list[Mention]:
    """Entities in order of place, without overlaps. Surnames met behind a title count where they stand alone too."""
    out: list[Mention] = []
    for m in PATTERN.finditer(text):
        if m["name"]:
            out += name_mentions(m)
            continue
        kind = m.lastgroup
        start, end = m.span(kind)
        out.append((start, end, kind, canonical(kind, text[start:end])))
    names = {c: k for _, _, k, c in out if k.startswith("surname") and len(c) > 2}
    if names:
        taken = [(a, b) for a, b, _, _ in out]
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((m.start(), m.end(), names[m.group()], m.group()))
        out.sort()
    return out


class Draw:
    """Numbers from a keyed hash, as many as asked for."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.count, self.pool = key, "|".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.what + b"|%d" % self.count, hashlib.sha256).digest()
            self.count += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """Digits for digits, letters for letters of the same case, all else as it is."""
        out = []
        for c in text:
            if hexadecimal and c in "0123456789abcdef":
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letter = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octets(draw: Draw, ip: str, attempt: int) -> str:
    a, b = map(int, ip.split(".")[:2])
    low = [str(draw.below(256)) for _ in range(3)]
    private = a in (10, 127) or (a, b) == (192, 168) or (a == 172 and 16 <= b <= 31)
    if private and TRIES <= attempt < 2 * TRIES:
        return ".".join(["10", *low])
    if private and attempt < TRIES:
        if a == 10 or a == 127:
            return ".".join([str(a), *low])
        if a == 192:
            return ".".join(["192", "168", *low[1:]])
        return ".".join(["172", str(16 + draw.below(16)), *low[1:]])
    first = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]
    address = ".".join([str(first[draw.below(len(first))]), *low])
    return address if attempt < 3 * TRIES else f"{address}:{1 + draw.below(65535)}"


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The ``attempt``-th replacement of an entity, in canonical form."""
    draw = Draw(key, kind, canon, attempt)
    longer = max(0, attempt - TRIES + 1)
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        # The domain's own draw, so that two addresses of one domain stay in one domain.
        other = Draw(key, "domain", domain).like(host)
        return f"{draw.like(local + 'a' * longer)}@{other}.{top}"
    if kind == "ip":
        return _octets(draw, canon, attempt)
    if kind == "card":
        body = canon[0] + draw.like(canon[1:] + "0" * longer)
        good = luhn(canon)
        ends = [body[:-1] + str(d) for d in range(10) if luhn(body[:-1] + str(d)) == good]
        return body if luhn(body) == good else ends[draw.below(len(ends))]
    if kind in ("phone", "ssn"):
        return draw.like(canon + "0" * longer)
    if kind == "key":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in range(len(canon) - 4 + longer))
    if kind == "iban":
        return canon[:2] + draw.like(canon[2:] + "0" * longer)
    if kind.startswith("given:"):
        _, writing, gender = kind.split(":")
        names = [n for (w, g), ns in GIVEN.items() if w == writing and gender in (g, "x") for n in ns]
        name = names[draw.below(len(names))]
        return name if not attempt else f"{name}-{_built(draw, writing, 1 + attempt // TRIES)}"
    if kind.startswith("surname:"):
        return _built(draw, kind.split(":")[1], 3 + longer)
    return draw.like(canon + "a" * longer, hexadecimal=re.fullmatch(r"[0-9a-f]+", canon) is not None)


def _built(draw: Draw, writing: str, syllables: int) -> str:
    parts = SYLLABLES[writing]
    return "".join(parts[draw.below(len(parts))] for _ in range(syllables)).capitalize()


def dressed(kind: str, text: str, new: str) -> str:
    """A surrogate in the spelling of the mention: its separators, its country code."""
    if kind in ("phone", "card", "ssn"):
        left = iter((digits(text)[: country_digits(text)] if kind == "phone" else "") + new)
        return "".join([next(left) if c.isdigit() else c for c in text]) + "".join(left)
    if kind == "iban" and " " in text:
        return " ".join(new[i : i + 4] for i in range(0, len(new), 4))
    if kind == "email":
        local, host = text.rsplit("@", 1)
        to_local, to_host = new.rsplit("@", 1)
        return f"{to_local.upper() if local.isupper() else to_local}@{to_host.upper() if host.isupper() else to_host}"
    return new


def replaced(text: str, found: list[Mention], new: Callable[[str, str], str]) -> str:
    out, at = [], 0
    for start, end, kind, canon in found:
        out += [text[at:start], dressed(kind, text[start:end], new(kind, canon))]
        at = end
    return "".join([*out, text[at:]])


def entity_table(texts: DataFrame) -> DataFrame:
    """(id, kind, canon): the distinct entities of each text of (id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            rows += [(key, k, c) for k, c in sorted({(k, c) for _, _, k, c in mentions(text or "")})]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        kinds = (pa.binary(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "kind", "canon"])

    return map_batches(texts, run, "id binary, kind string, canon string")


def _drawn(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, canons = batch.column("kind").to_pylist(), batch.column("canon").to_pylist()
        new = [surrogate(key, k, c, attempt) for k, c in zip(kinds, canons)]
        return pa.RecordBatch.from_arrays([*batch.select(["kind", "canon"]).columns, pa.array(new, pa.string())], names=["kind", "canon", "new"])

    drawn = map_batches(entities.select("kind", "canon"), run, "kind string, canon string, new string")
    return drawn.withColumn("attempt", F.lit(attempt))


def _space(kind):
    """Kinds that share their surrogates: all given names of a script are one space, whatever their gender."""
    return F.when(kind.startswith("given:"), F.substring_index(kind, ":", 2)).otherwise(kind)


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, new): distinct surrogates for distinct entities (kind, canon).

    Of entities that draw the same surrogate the one that drew it first, then the least, keeps it; the
    rest draw again, as does an entity whose surrogate is a real entity.
    """
    real = entities.select(_space(F.col("kind")).alias("space"), F.col("canon").alias("new")).distinct()
    done, pending, attempt = None, entities.select("kind", "canon"), 0
    while True:
        drawn = _drawn(pending, key, attempt)
        every = drawn if done is None else drawn.unionByName(done)
        every = every.withColumn("space", _space(F.col("kind")))
        winner = every.groupBy("space", "new").agg(F.min(F.struct("attempt", "kind", "canon")).alias("best"))
        free = winner.join(real, ["space", "new"], "left_anti")
        kept = free.select("best.kind", "best.canon", "new", "best.attempt")
        done = stored(kept, "surrogates")
        pending = stored(entities.select("kind", "canon").join(done, ["kind", "canon"], "left_anti"), "pending")
        if not pending.head(1):
            return done.drop("attempt")
        attempt += 1


def replace_private(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """All columns of ``docs``, with surrogates for the entities in ``text``.

    ``key`` is the secret of the draws. With ``count``, a column of that name gets the number of mentions.
    A null text stays null; an empty one, and one without entities, stays as it is. Equal
    texts get equal results; rows with null or repeated ids are treated like any other; columns of
    any name are kept. An empty table stays empty.
    """
    names = [c for c in docs.columns if c != count]
    key_of, pairs_of, hits_of = fresh(names, "id", "new", "hits")
    rows = docs.select(*[F.col(c) for c in names])
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    clean = rows.filter(~hinted)
    open_ = rows.filter(hinted).withColumn(key_of, F.unhex(F.md5(F.encode(F.col(text), "UTF-8"))))
    texts = open_.select(F.col(key_of).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])
    found = stored(entity_table(texts), "entities")
    table = assign(found.select("kind", "canon").distinct(), key)
    per_text = (
        found.join(table, ["kind", "canon"])
        .groupBy(F.col("id").alias(key_of))
        .agg(F.collect_list(F.struct("kind", "canon", "new")).alias(pairs_of))
    )
    joined = open_.join(per_text, key_of, "left").drop(key_of)
    place = names.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old, known = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        new, counts = [], []
        for value, pairs in zip(old, known):
            at = {(p["kind"], p["canon"]): p["new"] for p in pairs or []}
            hits = mentions(value) if at else []
            counts.append(len(hits))
            new.append(replaced(value, hits, lambda k, c: at[(k, c)]) if hits else value)
        columns = list(batch.columns[:-1])
        columns[place] = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, hits_of])

    schema = T.StructType([*rows.schema.fields, T.StructField(hits_of, T.LongType())])
    done = map_batches(joined, run, schema).unionByName(clean.withColumn(hits_of, F.lit(0).cast("long")))
    return done.withColumnRenamed(hits_of, count) if count else done.drop(hits_of)
