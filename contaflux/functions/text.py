"""Text keys: accents, names, phones, slugs, masks, search terms, classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a mark and the ones without. Fixed values.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
#: Words that a search ignores. Fixed values.
STOP_WORDS = """
a as o os um uma uns umas de do da dos das no na nos nas em por para com sem sob
e ou mas que se ser ter haver fazer este esta isto aquilo aqui ali eu tu ele ela nos
vos eles elas meu minha teu tua seu sua nosso quanto quanta quantos quantas qual quais como quando
onde mostra mostre mostra-me detalhes documento documentos fatura faturas todos todas mes ano
estou voce preciso saber consigo tenho tens tem
""".split()


def strip_accents(s: Column) -> Column:
    """Composed letters and free combining marks lose their marks."""
    return F.translate(F.regexp_replace(s, r"[̀-ͯ]", ""), MARKED, PLAIN)


def reference_key(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    plain = F.when(F.octet_length(s) == F.length(s), s).otherwise(strip_accents(s))  # ASCII has no accents
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def name_key(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(s, F.lit("")))), "[^a-z0-9]+", " "))


def phone_key(s: Column) -> Column:
    return F.right(F.regexp_replace(F.coalesce(s, F.lit("")), r"\D", ""), F.lit(9))


def path_slug(s: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(s), r"\s+", "_"), r"[^a-z0-9_.-]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("_"))


def file_slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(s), "[^A-Za-z0-9]+", "-"), "^-|-$", "")


def masked_iban(s: Column) -> Column:
    plain = F.upper(F.regexp_replace(s, r"[\s.-]", ""))
    return F.when(F.length(plain) >= 8, F.concat(F.left(plain, F.lit(4)), F.lit("••••"), F.right(plain, F.lit(4)))).otherwise(s)


def xml_escaped(s: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(plain), F.lit(name))
    return s


def csv_escaped(s: Column) -> Column:
    return F.when(s.rlike('[";\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def filled(template: Column, context: dict[str, Column]) -> Column:
    """{Token} replaced by its value; an unknown token becomes _Token_."""
    for token, value in context.items():
        template = F.replace(template, F.lit("{" + token + "}"), value)
    return F.regexp_replace(template, r"\{(\w+)\}", r"_$1_")


#: Between an ASCII letter, digit or underscore and anything else.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def search_terms(query: Column, most: int = 12) -> Column:
    """Words of three letters on without stop words, then codes and numbers as they were written."""
    words = F.filter(F.split(F.lower(strip_accents(query)), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    codes = F.regexp_extract_all(query, F.lit(rf"({_EDGE}[A-Z0-9/-]{{3,}}{_EDGE}|{_EDGE}\d{{2,}}{_EDGE})"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(words, F.transform(codes, F.lower))), 1, most)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def chunks(text: Column, size: int = 80, step: int = 64) -> Column:
    """Overlapping windows of words, as an array of strings. The words are bound once, as the
    element of an array: under the inner lambda the text would be split anew for each window."""

    def windows(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))

    return F.element_at(F.transform(F.array(words_of(text)), windows), 1)


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first regular expression that the text matches."""
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


#: Questions by intent, first match wins, over the lower-cased question. Fixed values.
INTENTS = [
    ("AGGREGATION", r"total|soma|quanto|quantos|agregado|saldo|m[eé]dia|ranking"),
    ("LOOKUP", r"mostra|detalhes|fatura\s+ft|documento\s+espec|qual\s+a\s+fatura|procurar|qual\s+doc"),
    ("COMPARISON", r"vs|comparar|compara|diferen[cç]a|comparativo"),
    ("ANOMALY", r"suspeit|an[oó]mal|estranh|at[ií]pic|fraude|erro\s+fiscal"),
    ("EXPLANATION", r"explica|como\s+funciona|por\s+que|o\s+que\s+[eé]"),
    ("PREDICTION", r"prev|proje|futuro|pr[oó]xim|tend[eê]ncia"),
    ("DUPLICATE_CHECK", r"duplicad|repetid|j[aá]\s+existe"),
    ("STATUS", r"estado|status|pendente|por\s+processar|em\s+revis"),
    ("CLASSIFY", r"classific|que\s+tipo|categoria"),
    ("EXPORT", r"export|csv|excel|saf-t|download"),
]
#: Currencies by what a text says, countries of currencies, locales of countries. Fixed values.
CURRENCIES = [("GBP", r"\bGBP\b|£"), ("USD", r"\bUSD\b|\$"), ("CHF", r"(?i)\bCHF\b|\bSFr\.?\b")]
CURRENCY_COUNTRIES = {"GBP": "GB", "USD": "US", "CHF": "CH"}
LOCALES = {"PT": "pt-PT", "ES": "es-ES", "DE": "de-DE", "FR": "fr-FR", "GB": "en-GB", "IE": "en-IE"}
#: Document types by what a text says, credit notes first. Fixed values.
TEXT_TYPES = [
    ("NOTA_CREDITO", r"(?i)\b(?:nota\s*(?:de\s*)?cr[eé]dito|credit\s*note|gutschrift(?:-srechnung)?|avoir)\b"),
    ("NOTA_DEBITO", r"(?i)\b(?:nota\s*(?:de\s*)?d[eé]bito|debit\s*note|belastungsanzeige)\b"),
    ("RECIBO", r"(?i)\b(?:recibo|receipt|quittung|quittance|ricevuta|reçu|recibo\s*de\s*vencimentos)\b"),
    ("FATURA_RECEBIDA", r"(?i)\b(?:fatura(?:\s*recebida)?|factura|facture|invoice|rechnung|fattura|nota\s*de\s*encomenda)\b"),
]
#: Labels that a language model gives document types, by the type they stand for. Fixed values.
LABEL_TYPES = {
    "NOTA_CREDITO": "NC NOTA_CREDITO CREDIT_NOTE GUTSCHRIFT GUTSCHRIFTSRECHNUNG AVOIR NOTA_DE_CREDITO",
    "NOTA_DEBITO": "ND NOTA_DEBITO DEBIT_NOTE BELASTUNGSANZEIGE",
    "RECIBO": "RC RECIBO RECIBO_VENCIMENTOS RECEIPT QUITTUNG QUITTANCE RICEVUTA RECU",
    "FATURA_RECEBIDA": "FT FR FS FATURA FATURA_RECEBIDA FACTURA FACTURE INVOICE RECHNUNG FATTURA",
    "FATURA_EMITIDA": "FATURA_EMITIDA FACTURE_EMISE",
    "COMPROVATIVO": "COMPROVATIVO PROOF_OF_PAYMENT",
    "ENCOMENDA": "ENCOMENDA ORDER BON_DE_COMMANDE",
    "GUIA_TRANSPORTE": "GUIA_TRANSPORTE GUIA_DE_TRANSPORTE DELIVERY_NOTE TRANSPORTE CMR PACKING_SLIP",
}
#: What tells the type in a longer label, first match wins. Fixed values.
LOOSE_TYPES = [
    ("NOTA_CREDITO", "nota.{0,3}credito|credit.{0,3}note|gutschrift|avoir"),
    ("NOTA_DEBITO", "nota.{0,3}debito|debit.{0,3}note|belastungsanzeige"),
    ("RECIBO", "recibo|receipt|quittung|quittance|ricevuta|recu"),
    ("FATURA_RECEBIDA", "fatura|factura|facture|invoice|rechnung|fattura"),
    ("COMPROVATIVO", "comprovativo|proof.of.payment"),
    ("ENCOMENDA", "encomenda|order|bon.de.commande"),
    ("GUIA_TRANSPORTE", "guia.{0,3}transporte|delivery.note|cmr|packing.slip"),
]
#: File extensions by MIME type. Fixed values.
EXTENSIONS = {
    "application/pdf": ".pdf", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/msword": ".doc",
}


def currency(text: Column) -> Column:
    return first_match(text, CURRENCIES, "EUR")


def intent(text: Column) -> Column:
    return first_match(F.lower(text), INTENTS, "GENERAL")


def text_type(text: Column) -> Column:
    return first_match(text, TEXT_TYPES, None)


def label_type(label: Column) -> Column:
    """The document type of a model's label: a known label without accents, blanks or case, else
    what a longer label holds; else null."""
    plain = F.regexp_replace(F.regexp_replace(strip_accents(label), r"[\s_-]+", "_"), r"\W", "")
    known = {word: kind for kind, words in LABEL_TYPES.items() for word in words.split()}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.when(plain != "", F.coalesce(F.try_element_at(table, F.upper(plain)), first_match(F.lower(plain), LOOSE_TYPES)))


def category_key(s: Column) -> Column:
    return F.lower(strip_accents(F.coalesce(s, F.lit(""))))


def category_slug(s: Column) -> Column:
    return path_slug(F.replace(F.coalesce(s, F.lit("")), F.lit("/"), F.lit("-")))


def origin_label(country: Column) -> Column:
    """Nacional for PT, Estrangeira for others, empty for none."""
    return F.when(F.coalesce(country, F.lit("")) == "", "").when(F.upper(F.trim(country)) == "PT", "Nacional").otherwise("Estrangeira")


def extension(name: Column) -> Column:
    """.ext in lower case, of 1 to 5 letters or digits; empty for none, and for names that hold a path."""
    unsafe = F.contains(name, F.lit("..")) | name.rlike(r"[/\\\x00]")
    found = F.regexp_extract(F.lower(name), r"(\.[a-z0-9]{1,5})$", 1)
    return F.when(F.coalesce(unsafe, F.lit(True)), "").otherwise(found)


def mime_extension(mime: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(mime)), F.lit(""))


def currency_country(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CURRENCY_COUNTRIES.items() for x in pair)), code)


def locale(country: Column) -> Column:
    """pt-PT and so on; of other countries the code in lower case, a dash, and the code."""
    table = F.create_map(*(F.lit(x) for pair in LOCALES.items() for x in pair))
    return F.when(F.coalesce(country, F.lit("")) != "", F.coalesce(F.try_element_at(table, country), F.concat(F.lower(country), F.lit("-"), country)))


def remittance(description: Column, number: Column, code: Column) -> Column:
    """What a payment is for, in 140 characters."""
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.left(F.concat_ws(" | ", some("", description), some("fat: ", number), some("atcud: ", code)), F.lit(140))


def labelled(*parts: tuple[str, Column]) -> Column:
    """A line for each part that isn't null or empty, with its label before it."""
    return F.concat_ws("\n", *(F.when(c.cast("string") != "", F.concat(F.lit(label), c.cast("string"))) for label, c in parts))


def asked_number(query: Column) -> Column:
    """The document number that a question names, like FT 2026/1; null if it names none."""
    shape = r"(?i)\b(FT|FS|FR|NC|ND|FA)\s*[:#]?\s*([A-Z0-9/_-]+)"
    return F.when(query.rlike(shape), F.concat(F.upper(F.regexp_extract(query, shape, 1)), F.lit(" "), F.regexp_extract(query, shape, 2)))


def asked_atcud(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, r"(?i)\bATCUD[:\s#]*([A-Z0-9-]+)", 1), F.lit(""))
