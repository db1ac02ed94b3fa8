"""Personal data replaced by keyed surrogates of the same type and form.

Entities are e-mail and IPv4 addresses, phone and card numbers, account and social
numbers, keys and passwords, and names: those after a title, and known given names before
a capitalised word. A part of a name found in a document is replaced wherever it stands in
it as a word of its own, capitalised or in capitals. Every entity has a canonical
form; its surrogate is drawn from a keyed hash of type, canonical form and attempt, so
one person's mentions agree everywhere without a lookup. A surrogate keeps length,
punctuation and letter case, digits stay digits, scripts stay, card numbers keep a valid
check digit, addresses stay addresses, and names keep the gender of their title.

Draws can collide, so the distinct entities of the corpus are checked: two entities
with one surrogate, or a surrogate that is itself an entity of the corpus, send all
but the first entity to the next attempt, until nothing collides. Some forms
have few others like them (a one-letter mail has 26), so from attempt SAME_FORM on they
grow by a letter, digit or syllable an attempt, and addresses take any octets. Forms
without a letter or digit get letters for their signs from the first attempt. Only the
few entities beyond attempt 0 have to be known when texts are rewritten: they are
broadcast if they are at most BROADCAST_ROWS, and otherwise joined to the documents
that hold them.

Defined cases: null text stays null with no entity; empty texts stay empty;
overlapping entities: the one that starts first, then the longer one; repeated rows
get the same surrogates; other columns are kept.
"""

import hashlib
import hmac
import re
from collections import Counter
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hourgrid.llm.common import map_rows

BROADCAST_ROWS = 100_000
ROUNDS = 50
SAME_FORM = 3
REWRITTEN = "struct<text:string,n:int>"

# Titles with the gender they tell, and given names of that gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Mx"),
}
GIVEN = {
    ("latin", "m"): "James Peter Thomas Daniel Martin Paul Lukas Felix Jonas Louis Hugo Pablo Diego Carlos Oscar Simon Victor Adam Leon Max".split(),
    ("latin", "f"): "Mary Anna Laura Julia Sophie Clara Emma Marie Alice Lucia Elena Carmen Paula Nora Eva Lena Ida Rosa Marta Helena".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил Павел Игорь".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Вера".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Πέτρος Ανδρέας".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Κατερίνα Σοφία".split(),
}
# More given names that tell a name without a title; no common words.
KNOWN = {
    "m": "John Robert Michael William David Richard Joseph Charles Christopher Matthew Anthony Steven Andrew Kenneth Kevin Brian George Edward Ronald Timothy Jeffrey Gary Nicholas Eric Stephen Jonathan Larry Scott Benjamin Samuel Gregory Patrick Alexander Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre Jean François Jacques Juan José Luis Miguel Javier".split(),
    "f": "Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Dorothy Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Catherine Christine Ursula Ingrid Sabine Monika Petra Isabelle Nathalie Camille Isabel Pilar Dolores Maria Teresa Louise Jane Christina Julie Caroline".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве да де до за ка ко ла ле ли ло ма ме ми мо на не но па по ра ре ро са се со та те то".split(),
    "greek": "βα βε γα γε δα δε ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το".split(),
}
GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}
GIVEN_GENDER = {
    **{n: gender for gender, names in KNOWN.items() for n in names},
    **{n: key[1] for key, names in GIVEN.items() for n in names},
}

TITLE = "|".join(sorted(map(re.escape, GENDER), key=len, reverse=True))
CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ][^\W\d_]+"
PATTERNS = (
    ("email", r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+", "@"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)", "."),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", "-"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", ""),
    ("awskey", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "A"),
    ("secret", r"(?i)(?<=[=:\s\"'])(?:(?:sk|pk|ghp|gho|xox[bp])[_-][A-Za-z0-9_-]{16,}|[0-9a-f]{32,64})(?![\w-])", ""),
    ("secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?(?P<value>[^\s\"',;]{6,})", ""),
    ("card", r"(?<![\w-])(?:[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)(?:[ -]?\d{4}){3}|3\d{3}[ -]?\d{6}[ -]?\d{4,5})(?![\w-])", ""),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", ""),
    ("name", rf"(?<!\w)(?P<title>{TITLE})\.? (?:(?:{TITLE})\.? )*(?P<value>{CAPITAL}(?: {CAPITAL})?)", ""),
)
COMPILED = [(kind, re.compile(pattern), needed) for kind, pattern, needed in PATTERNS]
DIGIT = re.compile(r"\d")
PAIR = re.compile(rf"(?<!\w)({CAPITAL})(?= ({CAPITAL}))")
TITLED = re.compile(rf"(?<!\w)(?:{TITLE})\.? ")


def found(text):
    """Spans (start, end, kind, canonical form) of a text, in order, not overlapping."""
    has_digit = DIGIT.search(text) is not None
    spans = []
    for kind, pattern, needed in COMPILED:
        if kind == "name":
            spans += names(text, pattern)
        elif (has_digit or kind in ("email", "secret")) and needed in text:
            if kind == "secret" and not has_digit and not SECRET_WORD.search(text):
                continue
            for match in pattern.finditer(text):
                group = "value" if "value" in pattern.groupindex else 0
                spans.append((*match.span(group), kind, canonical(kind, match.group(group))))
    spans.sort(key=lambda s: (s[0], -s[1]))
    kept, end = [], 0
    for span in spans:
        if span[0] >= end:
            kept.append(span)
            end = span[1]
    return kept


SECRET_WORD = re.compile(r"(?i)password|passwd|pwd|secret|token|api_?key")


def names(text, pattern):
    """Spans of the parts of names and of their further mentions in the text."""
    spans = list(titled(text, pattern)) if TITLED.search(text) else []
    spans += paired(text)
    if not spans:
        return spans
    parts = {}
    for start, end, kind, form in spans:
        for surface in (text[start:end], form.capitalize(), form.upper()):
            parts.setdefault(surface, (kind, form))
    longest = sorted(map(re.escape, parts), key=len, reverse=True)
    mentioned = re.compile(rf"(?<!\w)(?:{'|'.join(longest)})(?!\w)")
    spans += [(*match.span(), *parts[match.group()]) for match in mentioned.finditer(text)]
    return spans


def given(part, gender="n"):
    """The kind of a given name: by its own gender, else by that of the title."""
    return f"given-{GIVEN_GENDER.get(part.capitalize(), gender)}"


def titled(text, pattern):
    """Given name with gender and family name after a title; a given name alone is one."""
    for match in pattern.finditer(text):
        gender = GENDER[match["title"]]
        start = match.start("value")
        parts = match["value"].split(" ")
        for i, part in enumerate(parts):
            known = len(parts) == 1 and part.capitalize() in GIVEN_GENDER
            family = i == len(parts) - 1 and not known
            kind = "family" if family else given(part, gender)
            yield start, start + len(part), kind, canonical(kind, part)
            start += len(part) + 1


def paired(text):
    """Known given names before a capitalised word, and that word."""
    for match in PAIR.finditer(text):
        if match[1].capitalize() in GIVEN_GENDER:
            for part, group in ((match[1], 1), (match[2], 2)):
                known = group == 1 or part.capitalize() in GIVEN_GENDER
                kind = given(part) if known else "family"
                yield *match.span(group), kind, canonical(kind, part)


def canonical(kind, surface):
    """The form that all spellings of an entity share; country codes stay outside."""
    if kind == "phone":
        surface = surface[len(country_code(surface)) :]
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in surface if c.isdigit())
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "email" or kind == "family" or kind.startswith("given"):
        return surface.lower()
    return surface


COUNTRY = re.compile(r"\+\d{1,3}(?=\D)")


def country_code(phone):
    match = COUNTRY.match(phone)
    return match.group() if match else ""


class Draw:
    """Numbers from a keyed hash: the same for the same key, type, form and attempt."""

    def __init__(self, key, kind, form, attempt):
        seed = f"{kind}\0{attempt}\0{form}".encode("utf-8", "surrogatepass")
        self.seed = hmac.new(key, seed, hashlib.sha256).digest()
        self.state, self.turn = 0, 0

    def below(self, n):
        if self.state < n << 40:
            self.turn += 1
            block = hashlib.sha256(self.seed + self.turn.to_bytes(4, "big")).digest()
            self.state = int.from_bytes(block, "big")
        self.state, value = divmod(self.state, n)
        return value

    def of(self, choices):
        return choices[self.below(len(choices))]


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def like(draw, text):
    """Every letter and digit replaced by one of its kind; the rest stays."""
    hexadecimal = len(text) >= 16 and HEX.fullmatch(text) and DIGIT.search(text)
    out = []
    for c in text:
        if c.isdigit():
            out.append(draw.of("0123456789abcdef" if hexadecimal and c.islower() else DIGITS))
        elif hexadecimal:
            out.append(draw.of("abcdef" if c.islower() else "ABCDEF"))
        elif c.isalpha():
            out.append(draw.of(UPPER if c.isupper() else LOWER))
        else:
            out.append(c)
    return "".join(out)


def luhn(digits):
    """The check digit for some leading digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def octet(draw, digits):
    """An octet of as many digits, never a leading zero."""
    low, high = ((1, 9), (10, 99), (100, 254))[digits - 1]
    return str(low + draw.below(high - low + 1))


def script(text):
    for c in text:
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def wider(draw, text, extra):
    """``like`` with letters for a text of signs only, and ``extra`` more at the end."""
    if not any(c.isalpha() or c.isdigit() for c in text):
        text = "x" * len(text)
    more = DIGITS if text.isdigit() else LOWER if text == text.lower() else UPPER
    return like(draw, text) + "".join(draw.of(more) for _ in range(extra))


RESERVED = re.compile(r"(?:^|\.)example(?:\.(?:com|net|org))?$")


def surrogate(key, kind, form, attempt):
    """The canonical form that replaces ``form``."""
    draw = Draw(key, kind, form, attempt)
    extra = max(0, attempt - SAME_FORM + 1)
    if kind == "email":
        local, _, domain = form.partition("@")
        # Reserved domains stay; of others, the top level does.
        fixed = RESERVED.search(domain) or re.search(r"\.[^.]*$", domain)
        host, top = domain[: fixed.start()], fixed.group()
        return f"{wider(draw, local, extra)}@{like(draw, host)}{top}"
    if kind == "ip":
        if extra:
            return ".".join(str(draw.below(256)) for _ in range(4))
        return ".".join(octet(draw, len(part)) for part in form.split("."))
    if kind == "card":
        # Of the numbers that begin with 2, only 2221 to 2720 are cards.
        head = str(2221 + draw.below(500)) if form[0] == "2" else form[0]
        body = head + "".join(draw.of(DIGITS) for _ in range(len(form) - 1 - len(head) + extra))
        valid = luhn(form[:-1]) == form[-1]
        return body + (luhn(body) if valid else draw.of(DIGITS))
    if kind == "phone":
        first = "23456789"
        same = "".join(draw.of(first if c not in "01" else DIGITS) for c in form)
        return same + "".join(draw.of(DIGITS) for _ in range(extra))
    if kind in ("awskey", "iban"):
        head = 4 if kind == "awskey" else 2
        return form[:head] + wider(draw, form[head:], extra)
    if kind == "family":
        syllables = SYLLABLES[script(form)]
        return "".join(draw.of(syllables) for _ in range(4 + draw.below(2) + extra))
    if kind.startswith("given"):
        genders = "mf" if kind[-1] == "n" else kind[-1]
        names = [n for gender in genders for n in GIVEN[script(form), gender]]
        if attempt == 0:
            return draw.of(names).lower()
        # The plain names are few: later attempts add syllables.
        extra = range(1 + attempt // 8)
        return draw.of(names).lower() + "".join(draw.of(SYLLABLES[script(form)]) for _ in extra)
    return wider(draw, form, extra)


def rendered(kind, surface, form):
    """A canonical form in the punctuation and letter case of the surface it replaces."""
    if kind == "family" or kind.startswith("given"):
        return form.upper() if surface.isupper() else form.capitalize()
    if kind not in ("phone", "card", "ssn", "iban", "email"):
        return form
    if kind == "email":
        # Each side of its own: a longer local part leaves the case of the domain.
        sides = zip(form.split("@"), surface.split("@"))
        return "@".join(
            "".join(n.upper() if o.isupper() else n for n, o in zip_longest(new, old[: len(new)], fillvalue=""))
            for new, old in sides
        )
    signs = iter(form)
    out = [country_code(surface)] if kind == "phone" else []
    for c in surface[len("".join(out)) :]:
        out.append(next(signs) if c.isalnum() else c)
    return "".join([*out, *signs])


def replaced(text, key, attempts):
    """The text with surrogates, and how many there are. ``attempts``: beyond 0."""
    spans = found(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for start, end, kind, form in spans:
        new = surrogate(key, kind, form, attempts.get((kind, form), 0))
        out += [text[at:start], rendered(kind, text[start:end], new)]
        at = end
    return "".join([*out, text[at:]]), len(spans)


def mentions(docs):
    """kind, form and number of mentions, counted within each batch."""

    def rows(batch):
        counts = Counter(
            (kind, form) for text in batch["text"] if text for _, _, kind, form in found(text)
        )
        return {
            "kind": [k for k, _ in counts],
            "form": [f for _, f in counts],
            "mentions": list(counts.values()),
        }

    return map_rows(docs.select("text"), rows, "kind string, form string, mentions long")


def attempted(entities, key):
    """``entities`` (kind, form, attempt) with the surrogate of that attempt."""

    def rows(batch):
        made = [
            surrogate(key, k, f, a)
            for k, f, a in zip(batch["kind"], batch["form"], batch["attempt"])
        ]
        return {**batch, "surrogate": made}

    columns = entities.select("kind", "form", "attempt")
    return map_rows(columns, rows, "kind string, form string, attempt int, surrogate string")


def settled(scratch, docs, key):
    """kind, form, attempt and surrogate of every entity; no surrogate occurs twice.

    An entity keeps its surrogate if it is the first with it, by form, and the
    surrogate is no entity itself; those kept stay, the others draw again.
    """
    entities = scratch.stage(
        mentions(docs).groupBy("kind", "form").agg(F.sum("mentions").alias("mentions")),
        "entities",
    )
    taken = entities.select("kind", F.col("form").alias("surrogate"))
    kept = None
    waiting = entities.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        drawn = attempted(waiting, key)
        order = Window.partitionBy("kind", "surrogate").orderBy("form")
        first = drawn.withColumn("turn", F.row_number().over(order))
        used = taken.withColumn("used", F.lit(True))
        judged = first.join(used, ["kind", "surrogate"], "left")
        judged = scratch.stage(
            judged.select(
                "kind",
                "form",
                "attempt",
                "surrogate",
                (F.col("used").isNull() & (F.col("turn") == 1)).alias("free"),
            ),
            "drawn",
        )
        good = judged.where("free").drop("free")
        kept = good if kept is None else kept.union(good)
        taken = taken.union(good.select("kind", "surrogate"))
        waiting = judged.where(~F.col("free")).withColumn("attempt", F.col("attempt") + 1)
        if waiting.isEmpty():
            return kept
    raise ValueError("the surrogates of some type are used up")


def rewritten(docs, key, exceptions):
    """``docs`` with surrogates in ``text`` and their number in ``n_entities``."""
    later = exceptions.where("attempt > 0").select("kind", "form", "attempt")
    rows = later.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        known = docs.sparkSession.sparkContext.broadcast(
            {(r.kind, r.form): r.attempt for r in rows}
        )

        @pandas_udf(REWRITTEN)
        def run(texts: pd.Series) -> pd.DataFrame:
            made = [(None, 0) if t is None else replaced(t, key, known.value) for t in texts]
            return pd.DataFrame(made, columns=["text", "n"])

        made = docs.withColumn("__made", run("text"))
    else:
        made = with_joined(docs, key, later)
    return made.withColumn("text", F.col("__made.text")).withColumn(
        "n_entities", F.col("__made.n")
    ).drop("__made")


def with_joined(docs, key, later):
    """The way for many exceptions: every document gets its own by a join on its text."""

    def rows(batch):
        out = {"digest": [], "kind": [], "form": []}
        for text in batch["text"]:
            for kind, form in {(k, f) for _, _, k, f in found(text or "")}:
                out["digest"].append(hashlib.sha256((text or "").encode()).hexdigest())
                out["kind"].append(kind)
                out["form"].append(form)
        return out

    held = map_rows(docs.select("text"), rows, "digest string, kind string, form string")
    own = (
        held.distinct()
        .join(later, ["kind", "form"])
        .groupBy("digest")
        .agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("__own"))
        .withColumnRenamed("digest", "__digest")
    )

    @pandas_udf(REWRITTEN)
    def run(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        made = []
        for text, mine in zip(texts, own):
            known = {} if mine is None else {(e["kind"], e["form"]): e["attempt"] for e in mine}
            made.append((None, 0) if text is None else replaced(text, key, known))
        return pd.DataFrame(made, columns=["text", "n"])

    digest = F.sha2(F.col("text").cast("binary"), 256)
    joined = docs.withColumn("__digest", digest).join(own, "__digest", "left")
    return joined.withColumn("__made", run("text", "__own")).drop("__digest", "__own")


def replace_pii(scratch, docs, key):
    """``docs`` with every entity replaced, and ``n_entities``."""
    return rewritten(docs, key, settled(scratch, docs, key))
