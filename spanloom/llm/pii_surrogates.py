"""PII surrogates: every detected entity is replaced by a keyed one of its type, script, gender and format.

Types: email, phone (international, compact or grouped, and national forms with an area code), card (13-19 digits that pass the Luhn check), ssn,
iban (checked), ipv4, ipv6, birth (a date after a word of birth), street address (number and street), and person names: after a form of
address, after a cue ("name:", "I am", "Dear", ...), or a listed given name with a capitalised surname. Names without any of these are not
told from other capitalised words. A surname that was found is also replaced where it stands alone in the same text.
A surrogate depends on the key, the type and the entity's canonical form alone, so
one entity has one surrogate wherever it occurs and however it is written, while its writing (digit groups, letter case, script) is kept.
Names are replaced word by word, given names within their gender (either, where it isn't known) and script.

Collision checks cover the whole corpus: distinct entities and their surrogates are collected by type; where two entities
would share a surrogate, or a surrogate is itself an entity of the corpus, the later one (by canonical form) takes its next
surrogate, until none is left. Later surrogates come from larger spaces (longer names, all addresses, more years), and from the
GIVE_UP-th on only distinctness counts, so a space that the corpus fills doesn't stop it. Only these exceptions are shipped to the rewriting pass, by a join on
the entities of each document, so their number is not bounded by a task's memory.

Defined results: null texts stay null, empty ones empty; ids may be null or repeat, rows are rewritten each on its own; very long texts are read whole; other columns
are ignored, whatever their names; overlapping candidates go to the earlier, then the longer, then the first type listed above; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import small, store, trimmed

#: For tests and demonstrations; a production run passes its own secret.
DEMO_KEY = b"spanloom demonstration key"
GIVE_UP = 24

GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Jacob Nicholas Eric Jonathan Stephen Larry Scott Frank Raymond Gregory Patrick Peter Hans Klaus Jürgen Wolfgang Pierre Jacques François Antoine José Carlos Miguel Javier Fernando Diego".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Angela Shirley Anna Brenda Pamela Nicole Samantha Katherine Christine Helen Ursula Ingrid Monika Marie Camille Chloé Sophie María Carmen Lucía Isabel Pilar Elena".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Максим Иван Михаил Николай Владимир Павел Олег Юрий Виктор Игорь Антон".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Людмила Галина Юлия Вера Надежда Дарья Полина".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Γιάννης Νίκος Παναγιώτης Βασίλης Χρήστος".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
#: Further given names that are recognised; their surrogates come from the lists above.
KNOWN = {
    "m": "Ali Ahmed Mohammed Muhammad Omar Hassan Ibrahim Yusuf Khalid Raj Rahul Amit Arjun Vikram Sanjay Anil Suresh Wei Jun Ming Hao Lei Hiroshi Kenji Takashi Haruto Minho Jisoo Kwame Kofi Chinedu Emeka Tunde Luca Marco Giovanni Matteo Andreas Stefan Jens Lars Erik Johan Henrik Piotr Tomasz Pavel Luis Jorge Pedro Pablo Alejandro Manuel Louis Henri Alexander Benjamin Samuel Henry Jack Oliver Harry Noah Liam Ethan Lucas Adam Alan Bruce Carl Dennis Douglas Gary Gerald Harold Jerry Keith Philip Ralph Roger Ronald Roy Russell Walter Wayne".split(),
    "f": "Aisha Fatima Zainab Leila Yasmin Priya Ananya Anjali Deepa Kavita Lakshmi Sunita Mei Ling Xiu Yan Hua Yuki Sakura Aiko Haruka Soyeon Amina Ngozi Adaeze Abena Giulia Chiara Francesca Sofia Ingeborg Astrid Freya Karin Annika Agnieszka Katarzyna Ewa Ana Lucia Gabriela Valentina Camila Juliette Céline Claire Emma Olivia Ava Isabella Mia Charlotte Amelia Grace Alice Amy Diana Evelyn Frances Gloria Helena Irene Jane Janet Joan Joyce Judith Julia Julie Kelly Laurie Martha Megan Rachel Ruth Teresa Theresa Virginia Wendy".split(),
}
_GENDER = {n.lower(): g for (_, g), names in GIVEN.items() for n in names} | {n.lower(): g for g, names in KNOWN.items() for n in names}
_FORMS = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "señor": "m", "señora": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f"}
_SYLLABLES = {
    "latin": ["bar", "ben", "cor", "dal", "den", "fal", "gar", "hol", "kel", "lan", "mar", "mon", "nor", "per", "ral", "ros", "sel", "tan", "ver", "wil"],
    "cyrillic": ["бар", "бел", "вол", "гор", "дан", "зор", "кал", "кор", "лан", "мар", "мел", "нев", "пет", "рад", "сев", "сол", "тар", "фед", "хол", "чер"],
    "greek": ["βαρ", "γαλ", "δαν", "ζερ", "θαλ", "καρ", "λαμ", "μαν", "νικ", "παλ", "ραν", "σαρ", "τελ", "φιλ", "χαρ", "ψαλ", "μελ", "κολ", "δορ", "λεν"],
}
_ENDS = {("latin", "m"): "", ("latin", "f"): "", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("greek", "m"): "ος", ("greek", "f"): "ου"}

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁΆ-Ω][\w’'-]{1,30}"
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])")
CARD = re.compile(r"(?<![\d.,-])\d(?:[ -]?\d){12,18}(?![\d-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)")
SSN = re.compile(r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
PHONE = re.compile(
    r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|(?:1 )?\d{3} \d{3} \d{4}|1-8\d\d-\d{3}-\d{4}"
    r"|\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,5})?|0\d{2,4} \d{3,4} ?\d{3,4})(?![\w-])"
)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){0,7}:{0,2}(?![\w:.])")
BIRTH = re.compile(r"(?i:\b(?:born|dob|d\.o\.b\.|date of birth|birth ?date|birthday|geboren|né|née|nacid[oa])(?: (?:on|am|le|el|is))?\s?:?\s?)(?P<v>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\d)")
STREET = re.compile(r"(?<![\w.,-])(?P<n>\d{1,5}) (?P<s>(?:[A-ZÀ-ÖØ-Þ][\w'’-]{1,30} ){1,3})(?P<k>Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way)\b")
_ALL_FORMS = sorted({w for f in _FORMS for w in (f, f.capitalize(), f.upper())})
_ALL_GIVEN = sorted({w for v in (*GIVEN.values(), *KNOWN.values()) for n in v for w in (n, n.upper())}, key=lambda n: (-len(n), n))
NAME = re.compile(rf"(?<!\w)(?:(?P<form>{'|'.join(_ALL_FORMS)})\.? +(?P<a>{_NAME})(?: +(?P<b>{_NAME}))?|(?P<c>{'|'.join(_ALL_GIVEN)}) +(?P<d>{_NAME}))(?!\w)")
CUE = re.compile(rf"(?:\b(?i:name(?: is)?|i am|i['’]m|dear|attn|contact|signed|sincerely|regards|author)\s?[:,]?)\s(?P<a>{_NAME}) +(?P<b>{_NAME})(?: +(?P<c>{_NAME}))?(?!\w)")
_CUES = re.compile(r"(?i)\b(?:name|i am|i['’]m|dear|attn|contact|signed|sincerely|regards|author)\b")
#: Any text with a name has one of these words; sets of words are compared much faster than the pattern.
_WORDS = re.compile(r"[^\W\d_]+")
_NAME_SIGNS = frozenset(_ALL_FORMS + _ALL_GIVEN)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> int:
    """0 if the last digit is right; else what it lacks."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) of the entities in a text, in order, none over another."""
    out: list[tuple[int, int, int, str, str]] = []

    def add(order: int, begin: int, end: int, kind: str, canonical: str) -> None:
        out.append((begin, begin - end, order, kind, canonical))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(0, *m.span(), "email", m.group().lower())
    if ":" in text and "::" in text or text.count(":") > 2:
        for m in IPV6.finditer(text):
            if sum(c != ":" for c in m.group()) < 6:  # a::b is more often code
                continue
            try:
                add(5, *m.span(), "ipv6", ipaddress.IPv6Address(m.group()).compressed)
            except ValueError:
                pass
    if _DIGIT.search(text):
        for m in BIRTH.finditer(text):
            add(6, *m.span("v"), "birth", re.sub(r"\D", "-", m["v"]))
        for m in STREET.finditer(text):
            add(6, m.start("n"), m.end("s") - 1, "street", f"{m['n']} {m['s'].strip().lower()}")
        for m in PHONE.finditer(text):
            d = re.sub(r"\D", "", m.group())
            if 8 <= len(d) <= 15:
                add(1, *m.span(), "phone", ("+" if m.group()[0] == "+" else "") + d)
        for m in CARD.finditer(text):
            d = re.sub(r"\D", "", m.group())
            if luhn(d) == 0 and len(set(d)) > 1:
                add(2, *m.span(), "card", d)
        for m in SSN.finditer(text):
            add(3, *m.span(), "ssn", m.group().replace("-", ""))
        for m in IBAN.finditer(text):
            c = m.group().replace(" ", "")
            if _iban_ok(c):
                add(4, *m.span(), "iban", c)
        for m in IPV4.finditer(text):
            add(5, *m.span(), "ipv4", str(ipaddress.IPv4Address(int.from_bytes(bytes(map(int, m.group().split("."))), "big"))))
    words = _WORDS.findall(text)
    named: dict[str, str] = {}

    def add_name(m: re.Match, gender: str, given: str | None, *surnames: str) -> None:
        if given:
            add(7, *m.span(given), f"given-{gender}", m[given].lower())
        for group in surnames:
            if m[group]:
                add(7, *m.span(group), f"surname-{gender}", m[group].lower())
                named.setdefault(m[group], gender)

    if not _NAME_SIGNS.isdisjoint(words):
        for m in NAME.finditer(text):
            if m["form"]:
                gender = _FORMS[m["form"].lower()]
                if m["b"] or m["a"].lower() in _GENDER:
                    add_name(m, gender, "a", "b")
                else:
                    add_name(m, gender, None, "a")
            else:
                add_name(m, _GENDER[m["c"].lower()], "c", "d")
    if _CUES.search(text):
        for m in CUE.finditer(text):
            if m["a"].lower() not in _FORMS:
                add_name(m, _GENDER.get(m["a"].lower(), "u"), "a", "b", "c")
    # a surname that was found, standing alone elsewhere in the text
    for word, gender in named.items():
        for m in re.finditer(rf"(?<![\w'’-]){re.escape(word)}(?![\w'’-])", text) if words.count(word) > 1 or not word.isalpha() else ():
            add(8, *m.span(), f"surname-{gender}", word.lower())
    taken, end = [], -1
    for begin, minus, _, kind, canonical in sorted(out):
        if begin >= end:
            end = begin - minus
            taken.append((begin, end, kind, canonical))
    return taken


class Surrogates:
    """Canonical surrogates, by keyed hashes. attempt 0 is the usual one; later ones are for collisions."""

    def __init__(self, key: bytes = DEMO_KEY):
        self.key = key

    def number(self, kind: str, canonical: str, attempt: int, what: str = "") -> int:
        return int.from_bytes(hmac.new(self.key, f"{kind}\0{canonical}\0{attempt}\0{what}".encode(), hashlib.sha256).digest(), "big")

    def canonical(self, kind: str, value: str, attempt: int = 0) -> str:
        n = self.number(kind, value, attempt)
        if kind == "email":
            name, domain = value.rsplit("@", 1)
            # one domain has one surrogate, in a name reserved for examples
            d = self.number("domain", domain, 0)
            parts, left = [], n
            for run in re.split(r"([._+-])", name):
                if re.fullmatch(r"[._+-]", run):
                    parts.append(run)
                    continue
                parts.append("".join(self._like(c, left := left // 37 or self.number(kind, value, attempt, run + str(i))) for i, c in enumerate(run)))
            return f"{''.join(parts)}-{n % 36**4:x}@{_word('latin', d, 3)}.example"
        if kind == "phone":
            plus, d = ("+", value[1:]) if value[0] == "+" else ("", value)
            country = d[: max(0, len(d) - 10)] if plus else d[:1] if d[0] in "01" else ""  # or the digit dialled before an area code
            rest = d[len(country) :]
            out = "".join(str((n >> (8 * i)) % 10) for i in range(len(rest)))
            return plus + country + "23456789"[(n >> 200) % 8] + out[1:]
        if kind == "card":
            d = value[0] + "".join(str((n >> (8 * i)) % 10) for i in range(len(value) - 2)) + "0"
            return d[:-1] + str((10 - luhn(d)) % 10)
        if kind == "ssn":
            return f"{1 + n % 665:03d}{1 + (n >> 32) % 99:02d}{1 + (n >> 64) % 9999:04d}"
        if kind == "iban":
            body = "".join(str((n >> (8 * i)) % 10) if c.isdigit() else chr(65 + (n >> (8 * i)) % 26) for i, c in enumerate(value[4:]))
            return f"{value[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + value[:2] + '00')) % 97:02d}{body}"
        if kind == "ipv6":
            return ipaddress.IPv6Address((0x20010DB8 << 96) | n % (1 << 96)).compressed  # the network that is kept for examples
        if kind == "birth":
            parts = value.split("-")
            year = parts[0] if len(parts[0]) == 4 else parts[-1]
            wide = 120 if attempt < 8 else 2000
            others = iter(f"{1 + (n >> (16 * i)) % 12:0{len(p)}d}"[-2:] if int(p) <= 12 else f"{13 + (n >> (16 * i)) % 16:02d}" for i, p in enumerate(p for p in parts if p is not year))
            return "-".join(f"{(1900 if attempt < 8 else 1000) + (n >> 64) % wide:04d}" if p is year else next(others) for p in parts)
        if kind == "street":
            number, name = value.split(" ", 1)
            return f"{str(1 + n % 9)}{''.join(str((n >> (8 * i)) % 10) for i in range(1, len(number)))} " + " ".join(_word("latin", n >> (64 + 48 * i), 3 + attempt // 16) for i in range(len(name.split(" "))))
        if kind == "ipv4":
            ip = ipaddress.IPv4Address(value)
            if attempt >= 8 and ip.is_private:
                return str(ipaddress.IPv4Address((10 << 24) + 1 + n % ((1 << 24) - 2)))
            for net in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8"):
                if ip in (network := ipaddress.ip_network(net)):
                    return str(network[1 + n % (network.num_addresses - 2)])
            return f"{(11 + n % 89) if n >> 250 & 1 else (128 + n % 40)}.{(n >> 16) % 256}.{(n >> 32) % 256}.{1 + (n >> 48) % 254}"
        script, gender = script_of(value), kind[-1]
        if kind.startswith("given"):
            names = GIVEN[script, gender] if gender != "u" else GIVEN[script, "m"] + GIVEN[script, "f"]
            first = names[n % len(names)].lower()
            # the list is short: further names are double ones
            return first if attempt == 0 else f"{first}-{names[(n >> 64) % len(names)].lower()}" if attempt < 8 else f"{first}-{_word(script, n >> 64, 2 + attempt // 8)}"
        return _word(script, n, 3 + attempt // 8) + _ENDS[script, gender if gender != "u" else "m"]

    @staticmethod
    def _like(c: str, n: int) -> str:
        return str(n % 10) if c.isdigit() else chr(97 + n % 26) if c.isalpha() else c

    @staticmethod
    def written(kind: str, canonical: str, as_text: str) -> str:
        """The canonical surrogate in the writing of the text it replaces."""
        if kind in ("phone", "card", "ssn", "iban"):
            new = iter(canonical.lstrip("+") if kind == "phone" else canonical)
            return "".join(next(new) if c.isalnum() else c for c in as_text)
        if kind in ("ipv4", "ipv6"):
            return canonical.upper() if as_text.isupper() else canonical
        if kind == "birth":
            new = iter(canonical.split("-"))
            return re.sub(r"\d+", lambda m: next(new), as_text)
        if kind == "street":
            return canonical.upper() if as_text.isupper() else canonical.title()
        if as_text.isupper() and len(as_text) > 1:
            return canonical.upper()
        if kind == "email":
            return canonical[0].upper() + canonical[1:] if as_text[0].isupper() else canonical
        return "-".join(p[:1].upper() + p[1:] for p in canonical.split("-")) if as_text[0].isupper() else canonical


def _word(script: str, n: int, syllables: int) -> str:
    s = _SYLLABLES[script]
    return "".join(s[(n >> (16 * i)) % len(s)] for i in range(syllables))


def rewrite(text: str, surrogates: Surrogates, exceptions: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with surrogates, and the types replaced, in order."""
    out, at, kinds = [], 0, []
    for begin, end, kind, canonical in entities(text):
        new = surrogates.canonical(kind, canonical, exceptions.get((kind, canonical), 0))
        out += [text[at:begin], surrogates.written(kind, new, text[begin:end])]
        at = end
        kinds.append(kind)
    return "".join(out) + text[at:], kinds


def _domain(kind) -> F.Column:
    """Names of either gender share a space of surrogates: a surname is one person's whatever the form of address."""
    return F.regexp_replace(kind, "^(given|surname)-.$", "$1")


def exceptions_of(found: DataFrame, key: bytes) -> DataFrame:
    """found(kind, value) -> (kind, value, attempt) of the entities that can't take their first surrogate."""
    make = Surrogates(key)

    def surrogate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v, a = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([make.canonical(x, y, z) for x, y, z in zip(k, v, a)], pa.string())], ["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    values = found.select(_domain(F.col("kind")).alias("domain"), F.col("value").alias("surrogate")).distinct()
    now = store(found.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(surrogate, schema), "surrogates")
    while True:
        # the entity that keeps a surrogate: the one that has it longest, then the first
        rank = F.row_number().over(Window.partitionBy(_domain(F.col("kind")), "surrogate").orderBy("attempt", "value", "kind"))
        ranked = now.withColumn("domain", _domain(F.col("kind"))).withColumn("rank", rank)
        taken = ranked.join(values.withColumn("real", F.lit(True)), ["domain", "surrogate"], "left")
        again = taken.select("kind", "value", "attempt", "surrogate", ((F.col("real").isNotNull() & (F.col("attempt") < GIVE_UP)) | (F.col("rank") > 1)).alias("again"))
        again = store(again, "collisions")
        if again.where("again").isEmpty():
            return now.where("attempt > 0").select("kind", "value", "attempt")
        moved = again.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(surrogate, schema)
        now = store(again.where("not again").select("kind", "value", "attempt", "surrogate").unionAll(moved), "surrogates")


def surrogate_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = DEMO_KEY) -> DataFrame:
    """Rows (doc_id, text, replaced) of all documents: the text with surrogates, and how many entities were replaced.

    Documents that mention an exception get it by a join on their digest: broadcast if they are few, else by a shuffle of the texts.
    """

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(d, k, v) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, k, v in entities(text)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*sorted(rows))], ["digest", "kind", "value"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    digest = F.md5("text")
    own = store(texts.where("text is not null").select(digest.alias("digest"), "text").mapInArrow(trimmed(mentions), "digest string, kind string, value string").distinct(), "entities")
    exceptions = store(exceptions_of(own.select("kind", "value").distinct(), key), "exceptions")
    each = own.join(exceptions, ["kind", "value"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("exceptions"))
    each = store(each, "exceptions")
    make, n = Surrogates(key), each.count()
    if not n:
        return _rewritten(texts.withColumn("exceptions", F.lit(None).cast("array<struct<kind: string, value: string, attempt: int>>")), make)
    return _rewritten(texts.join(small(each.withColumnRenamed("digest", "own_digest"), n), digest == F.col("own_digest"), "left").select("doc_id", "text", "exceptions"), make)


def _rewritten(texts: DataFrame, make: Surrogates) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, counts = [], []
            for text, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is None:
                    new.append(None)
                    counts.append(0)
                    continue
                t, kinds = rewrite(text, make, {(e["kind"], e["value"]): e["attempt"] for e in mine or ()})
                new.append(t)
                counts.append(len(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "replaced"])

    return texts.mapInArrow(trimmed(run), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text string, replaced int")
