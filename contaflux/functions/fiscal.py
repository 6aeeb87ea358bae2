"""Fiscal identifiers: tax numbers, bank accounts, VAT shapes, fiscal QR payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contaflux.functions.dates import qr_date

#: Lengths of bank account numbers by country. Fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
#: Shapes of VAT numbers by country, with their prefix. Fixed values.
VAT_SHAPES = {
    "AT": r"ATU\d{8}", "BE": r"BE\d{10}", "BG": r"BG\d{9,10}", "CY": r"CY\d{8}[A-Z]", "CZ": r"CZ\d{8,10}", "DE": r"DE\d{9}", "DK": r"DK\d{8}",
    "EE": r"EE\d{9}", "ES": r"ES[A-Z0-9]\d{7}[A-Z0-9]", "FI": r"FI\d{8}", "FR": r"FR[A-Z0-9]{2}\d{9}", "GR": r"(?:GR|EL)\d{9}", "HR": r"HR\d{11}",
    "HU": r"HU\d{8}", "IE": r"IE\d{7}[A-Z0-9]{1,2}", "IT": r"IT\d{11}", "LT": r"LT(?:\d{9}|\d{12})", "LU": r"LU\d{8}", "LV": r"LV\d{11}", "MT": r"MT\d{8}",
    "NL": r"NL\d{9}B\d{2}", "PL": r"PL\d{10}", "RO": r"RO\d{2,10}", "SE": r"SE\d{12}", "SI": r"SI\d{8}", "SK": r"SK\d{10}", "GB": r"GB(?:\d{9}|\d{12}|GD\d{3}|HA\d{3})",
}
#: Codes of a fiscal QR payload's document type. Fixed values.
QR_TYPES = {"FT": "FATURA_RECEBIDA", "FR": "FATURA_RECEBIDA", "FS": "FATURA_RECEBIDA", "NC": "NOTA_CREDITO", "ND": "NOTA_DEBITO", "RC": "RECIBO", "RG": "RECIBO", "RP": "RECIBO"}
FINAL_CONSUMER = ["", "0", "000000000", "999999990"]


def nif_plain(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), r"^PT|[\s.\-]", "")


def nif_check_digit(first8: Column) -> Column:
    """Weights 9 to 2, modulo 11; below 2 counts as 0."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda a, i: a + F.substring(first8, i, F.lit(1)).try_cast("int") * (10 - i))
    rest = total % 11
    return F.when(rest < 2, F.lit(0)).otherwise(11 - rest)


def nif_class(nif: Column) -> Column:
    two, one = F.left(nif, F.lit(2)), F.left(nif, F.lit(1))
    return F.when(one.isin("1", "2", "3"), "pessoa_singular").when(two == "45", "nao_residente").when(one == "5", "pessoa_coletiva").when(one == "6", "administracao_publica").when(two.isin("70", "71", "72", "74", "75", "77", "78", "79"), "heranca_ou_fundo").when(one.isin("8", "9"), "irregular_ou_outro")


def nif_valid(s: Column) -> Column:
    return bound(nif_plain(s), _nif_holds)


def _nif_holds(nif: Column) -> Column:
    return F.coalesce(nif.rlike(r"^\d{9}$") & nif_class(nif).isNotNull() & (nif_check_digit(F.left(nif, F.lit(8))) == F.right(nif, F.lit(1)).try_cast("int")), F.lit(False))


def final_consumer(s: Column) -> Column:
    return nif_plain(s).isin(FINAL_CONSUMER)


def iban_plain(s: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), r"[\s.-]", ""))


def mod97(s: Column) -> Column:
    """The remainder of a number with letters (A = 10), digit by digit."""
    def step(a: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.try_cast("long")).otherwise(F.ascii(c) - 55)
        return F.when(value > 9, (a * 100 + value) % 97).otherwise((a * 10 + value) % 97).cast("long")

    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def iban_valid(s: Column) -> Column:
    """Shape, length of a known country (others: 15 to 34), remainder 1."""
    return bound(iban_plain(s), _iban_holds)


def _iban_holds(iban: Column) -> Column:
    fits = F.coalesce(F.length(iban) == F.element_at(mapping(IBAN_LENGTHS), F.left(iban, F.lit(2))), F.lit(True)) & F.length(iban).between(15, 34)
    turned = F.concat(F.substring(iban, 5, 40), F.left(iban, F.lit(4)))
    return iban.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$") & fits & (mod97(turned) == 1)


def mapping(values: dict) -> Column:
    """A constant map."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value) with value computed once: as the element of an array, under a lambda, it isn't
    written out again wherever build uses it."""
    return F.element_at(F.transform(F.array(value), build), 1)


def nib_valid(s: Column) -> Column:
    """Whether 21 digits are a national account number: divisible by 97."""
    nib = F.regexp_replace(F.coalesce(s, F.lit("")), r"\s", "")
    return nib.rlike(r"^\d{21}$") & (mod97(nib) == 0)


def iban_parsed(s: Column) -> Column:
    """A struct of the number's parts and its status: unknown (empty), valid or invalid. A
    Portuguese number whose national part isn't divisible by 97 is invalid."""
    return bound(iban_plain(s), _iban_parts)


def _iban_parts(iban: Column) -> Column:
    bban, pt = F.substring(iban, 5, 40), (F.left(iban, F.lit(2)) == "PT") & (F.length(iban) == 25)
    part = lambda at, n: F.when(pt, F.substring(bban, at, n))
    nib_ok = F.when(pt, nib_valid(bban))
    status = F.when(iban == "", "unknown").when(iban_valid(iban) & F.coalesce(nib_ok, F.lit(True)), "valid").otherwise("invalid")
    return F.struct(
        iban.alias("normalized"), F.left(iban, F.lit(2)).alias("country"), F.substring(iban, 3, 2).alias("check_digits"), bban.alias("bban"), status.alias("status"),
        part(1, 4).alias("bank"), part(5, 4).alias("branch"), part(9, 11).alias("account"), part(20, 2).alias("nib_digits"), nib_ok.alias("nib_valid"),
    )


def vat_plain(s: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", ""))


def vat_country(number: Column) -> Column:
    two = F.left(number, F.lit(2))
    return F.when(two == "EL", "GR").otherwise(two)


def vat_fits(number: Column) -> Column:
    """Whether a number with its prefix has the shape of its country; unknown countries have none."""
    out = F.lit(False)
    for name, shape in VAT_SHAPES.items():
        out = F.when(vat_country(number) == name, number.rlike(f"^{shape}$")).otherwise(out)
    return out


def tax_id_valid(country: Column, nif: Column, vat: Column) -> Column:
    """The tax number of a country: for PT the check digit, elsewhere the shape of the VAT number."""
    number = vat_plain(vat)
    return F.when(country == "PT", nif_valid(nif)).otherwise(number.rlike("^[A-Z]{2}[A-Z0-9]{2,12}$") & vat_fits(number))


def vat_shape_valid(country: Column, number: Column) -> Column:
    """Whether a number without its prefix has the shape of the country; for PT the check digit decides."""
    return F.when(country == "PT", nif_valid(number)).otherwise(vat_fits(F.concat(country, number)))


_LABELLED_VAT = r"(?i)(?:VAT(?:\s*(?:No\.?|ID))?|Tax\s*ID|USt-?IdNr\.?|N[ºo]\s*TVA|CIF)\s*[:#-]?\s*([A-Z]{2}[A-Z0-9 .-]{7,16})"
_NAKED_VAT = r"(?i)\b(ATU\d{8}|(?:BE|BG|CY|CZ|DE|DK|EE|ES|FI|FR|GR|EL|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|RO|SE|SI|SK|GB)[A-Z0-9]{7,13})\b"


def foreign_vat(text: Column) -> Column:
    """The first VAT number of a country other than PT in a text, as a struct of value and
    country; labelled ones come before naked ones. Null if there is none."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in (_LABELLED_VAT, _NAKED_VAT)))
    plain = F.transform(found, lambda x: F.upper(F.regexp_replace(x, "[ .-]", "")))
    fits = F.filter(plain, lambda x: (F.left(x, F.lit(2)) != "PT") & vat_fits(x))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first.alias("value"), vat_country(first).alias("country")))


def tenant_nif(s: Column) -> Column:
    """Digits only; eleven that begin with 35 lose these."""
    digits = F.regexp_replace(F.coalesce(s, F.lit("")), r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("35"), F.substring(digits, 3, 9)).otherwise(digits)


def atcud(s: Column) -> Column:
    """A struct of code and sequence of an ATCUD like ABCD1234-15; null if it is none."""
    shape = r"^([A-Z0-9]{6,10})-(\d{1,20})$"
    plain = F.upper(F.trim(s))
    return F.when(plain.rlike(shape), F.struct(F.regexp_extract(plain, shape, 1).alias("code"), F.regexp_extract(plain, shape, 2).alias("sequence")))


def qr_likely(s: Column) -> Column:
    """Whether a text of ten characters on looks like a fiscal QR payload."""
    return F.coalesce((F.length(s) >= 10) & (s.rlike(r"(?:^|\*)A:\d{9}") | (F.contains(s, F.lit("A:")) & F.contains(s, F.lit("*")))), F.lit(False))


def qr_field(payload: Column, letter: str) -> Column:
    """One field of a payload as it is written; null if it is missing or empty."""
    return F.nullif(F.regexp_extract(payload, rf"(?:^|\*){letter}:([^*]+)", 1), F.lit(""))


def qr_type(code: Column) -> Column:
    """The document type of a payload's code; null for an unknown code."""
    return F.try_element_at(mapping(QR_TYPES), F.upper(code))


def qr_fields(raw: Column) -> Column:
    """The fields of a fiscal QR payload as a map: pairs split at * and the first colon,
    keys in upper case, the last of the same key wins."""
    pairs = F.filter(F.split(F.coalesce(raw, F.lit("")), r"\*"), lambda p: F.instr(p, ":") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.upper(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.substr(p, F.instr(p, ":") + 1).alias("v")))
    turned = lambda found: F.struct(found.alias("found"), F.reverse(F.transform(found, lambda e: e["k"])).alias("keys"))
    # Counted from the end the last of a key comes first.
    last = lambda x: F.filter(x["found"], lambda e, i: i == F.size(x["keys"]) - F.array_position(x["keys"], e["k"]))
    return F.map_from_entries(bound(bound(entries, turned), last))


def qr_parsed(raw: Column) -> Column:
    """The named fields of a payload with an issuer, a unique number or an ATCUD; else null."""
    return bound(qr_fields(raw), _parsed)


def _value(fields: Column, code: str) -> Column:
    return F.nullif(F.try_element_at(fields, F.lit(code)), F.lit(""))


def _number(fields: Column, code: str) -> Column:
    return F.replace(_value(fields, code), F.lit(","), F.lit(".")).try_cast("double")


def _parsed(fields: Column) -> Column:
    value, number = lambda k: _value(fields, k), lambda k: _number(fields, k)
    buyer = F.when(~final_consumer(value("B")), value("B"))
    taxes = sum((F.coalesce(number(f"{p}{i}"), F.lit(0.0)) for p in "IJK" for i in (4, 6, 8)), F.lit(0.0))
    parsed = F.struct(
        value("A").alias("issuer_nif"), buyer.alias("buyer_nif"), value("C").alias("buyer_country"), value("D").alias("document_type"),
        qr_date(value("F")).alias("document_date"), value("G").alias("unique_doc_id"), value("H").alias("atcud"), F.coalesce(number("N"), F.when(taxes != 0, taxes)).alias("total_tax"), number("O").alias("total"),
    )
    return F.when(F.coalesce(value("A"), value("O"), value("H")).isNotNull(), parsed)


def qr_breakdown(raw: Column) -> Column:
    """An array with the VAT bases and taxes of each region that a payload has."""
    return bound(qr_fields(raw), _regions)


def _regions(fields: Column) -> Column:
    names = ["base_exempt", "base_reduced", "tax_reduced", "base_intermediate", "tax_intermediate", "base_normal", "tax_normal"]
    there = lambda p: F.coalesce(*(_value(fields, f"{p}{i}") for i in (1, 7, 2))).isNotNull()
    regions = [F.when(there(p), F.struct(_value(fields, f"{p}1").alias("region"), *(_number(fields, f"{p}{i + 2}").alias(n) for i, n in enumerate(names)))) for p in "IJK"]
    return F.filter(F.array(*regions), lambda r: r.isNotNull())


def qr_payload(fields: Column) -> Column:
    """A payload written from a map; null and empty values are left out."""
    kept = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.upper(e["key"]), F.lit(":"), e["value"])), "*")


#: Regions of a payload and their VAT rates: reduced, intermediate, normal. Fixed values.
REGION_RATES = {"PT": (6.0, 13.0, 23.0), "PT-AC": (4.0, 9.0, 16.0), "PT-MA": (5.0, 12.0, 22.0)}


def region_lines(block: Column) -> Column:
    """VAT lines (kind, rate, base, tax) of one region of qr_breakdown(). An exempt line needs a
    base that isn't 0, the others a base or a tax that isn't 0; what is missing counts as 0."""
    rate = lambda i: F.coalesce(*(F.when(block["region"] == name, rates[i]) for name, rates in REGION_RATES.items()), F.lit(REGION_RATES["PT"][i]))
    zero = lambda c: F.coalesce(block[c], F.lit(0.0))
    line = lambda kind, r, base, tax: F.struct(F.lit(kind).alias("kind"), r.alias("rate"), base.alias("base"), tax.alias("tax"))
    lines = [F.when(zero("base_exempt") != 0, line("exempt", F.lit(0.0), zero("base_exempt"), F.lit(0.0)))]
    for i, kind in enumerate(("reduced", "intermediate", "normal")):
        base, tax = f"base_{kind}", f"tax_{kind}"
        lines.append(F.when(block[base].isNotNull() | (zero(tax) != 0), line(kind, rate(i), zero(base), zero(tax))))
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def flat_breakdown(blocks: Column) -> Column:
    """(rate, base, tax) of each region's parts, by the rates 4 or 5, 12 and 23 that hints use;
    region_lines() has the rates of the law."""
    part = lambda b, kind, rate: F.when(b[f"base_{kind}"].isNotNull() | b[f"tax_{kind}"].isNotNull(), F.struct(rate.alias("rate"), F.coalesce(b[f"base_{kind}"], F.lit(0.0)).alias("base"), F.coalesce(b[f"tax_{kind}"], F.lit(0.0)).alias("tax")))
    rows = F.transform(blocks, lambda b: F.array(part(b, "reduced", F.when(b["region"] == "PT", 4.0).otherwise(5.0)), part(b, "intermediate", F.lit(12.0)), part(b, "normal", F.lit(23.0))))
    return F.filter(F.flatten(rows), lambda x: x.isNotNull())


def qr_checked(raw: Column) -> Column:
    """A struct of errors and warnings (arrays of codes) of a payload, null where it is none."""
    return bound(qr_fields(raw), lambda fields: bound(F.struct(_parsed(fields).alias("p"), F.flatten(F.transform(_regions(fields), region_lines)).alias("lines")), lambda x: _checked(fields, x["p"], x["lines"])))


def _checked(fields: Column, parsed: Column, lines: Column) -> Column:
    value = lambda k: _value(fields, k)
    number = lambda k: F.coalesce(_number(fields, k), F.lit(0.0))
    total = lambda c: F.aggregate(lines, F.lit(0.0), lambda a, x: a + x[c])
    off = F.exists(lines, lambda x: F.abs(x["tax"] - F.floor(x["base"] * x["rate"] + 0.5) / 100) > 0.02 + 1e-9)
    gross = total("base") + total("tax") + number("M") + number("L") - number("P")
    told = lambda *rules: F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules)), lambda x: x.isNotNull())
    errors = told(
        ("issuer_nif", ~nif_valid(value("A"))), ("buyer_nif", parsed["buyer_nif"].isNotNull() & ~nif_valid(value("B"))), ("document_type", value("D").isNull()),
        ("document_date", ~F.coalesce(value("F").rlike(r"^\d{8}$"), F.lit(False))), ("atcud_missing", value("H").isNull()), ("atcud", value("H").isNotNull() & atcud(value("H")).isNull()),
        ("total", parsed["total"].isNull()), ("vat_line", off), ("vat_total", (F.size(lines) > 0) & parsed["total_tax"].isNotNull() & (F.abs(total("tax") - parsed["total_tax"]) > 0.02 + 1e-9)),
    )
    warnings = told(
        ("unique_id", value("G").isNull()), ("hash", value("Q").isNotNull() & ~value("Q").rlike("(?i)^[A-Z0-9]{4}$")), ("certificate", value("R").isNull()),
        ("sum", (F.size(lines) > 0) & parsed["total"].isNotNull() & (F.abs(gross - parsed["total"]) > 0.05 + 1e-9)),
    )
    return F.when(parsed.isNotNull(), F.struct(errors.alias("errors"), warnings.alias("warnings")))


def qr_document(raw: Column) -> Column:
    """The fields of a document that a payload tells: its type (received invoice if the code is
    unknown), number (else the ATCUD), date, issuer, buyer, total, tax and net."""
    return bound(qr_parsed(raw), lambda parsed: F.when(parsed.isNotNull(), F.struct(
        F.coalesce(qr_type(parsed["document_type"]), F.lit("FATURA_RECEBIDA")).alias("type"), F.coalesce(parsed["unique_doc_id"], parsed["atcud"]).alias("number"), parsed["document_date"].alias("date"),
        parsed["issuer_nif"].alias("supplier_nif"), parsed["buyer_nif"].alias("customer_nif"), parsed["total"].alias("total"), parsed["total_tax"].alias("tax"),
        F.greatest(parsed["total"] - F.coalesce(parsed["total_tax"], F.lit(0.0)), F.lit(0.0)).alias("net"), F.lit(0.95).alias("confidence"),
    )))


#: Document types by a payload's code as forms show them; others are received invoices. Fixed values.
FORM_TYPES = {"FT": "fatura_recebida", "FR": "fatura_recebida", "FS": "fatura_recebida", "NC": "outro", "ND": "outro", "RC": "recibo", "RG": "recibo", "RP": "recibo"}


def qr_form(raw: Column) -> Column:
    """What a form is filled with from a payload: type, number (else the ATCUD), date, issuer, total and tax."""

    def form(parsed: Column) -> Column:
        kind = F.coalesce(F.try_element_at(mapping(FORM_TYPES), F.upper(parsed["document_type"])), F.lit("fatura_recebida"))
        return F.when(parsed.isNotNull(), F.struct(kind.alias("type"), F.coalesce(parsed["unique_doc_id"], parsed["atcud"]).alias("number"), parsed["document_date"].alias("date"), parsed["issuer_nif"].alias("nif"), parsed["total"].alias("total"), parsed["total_tax"].alias("tax")))

    return bound(qr_parsed(raw), form)
