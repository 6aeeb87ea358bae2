"""Filing: folder rules as data, path patterns, file names, first-pass classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contaflux.functions.text import category_key, category_slug, file_slug, filled, origin_label, path_slug

#: Document types by the file name in capitals, first match wins, with their confidence. Fixed values.
NAME_TYPES = [
    ("FATURA_RECEBIDA", r"\bFT[_\-\s]|\bFATURA\b", 0.80),
    ("FATURA_SIMPLIFICADA", r"\bFS[_\-\s]", 0.80),
    ("FATURA_RECIBO", r"\bFR[_\-\s]", 0.80),
    ("NOTA_CREDITO", r"\bNC[_\-\s]", 0.75),
    ("NOTA_DEBITO", r"\bND[_\-\s]", 0.75),
    ("DUA_IMPORTACAO", r"\bDUA\b", 0.90),
    ("RECIBO_PAGAMENTO", r"\bRECIBO\b", 0.80),
    ("GUIA_TRANSPORTE", r"\bGUIA[_\-\s]", 0.75),
    ("EXTRATO_BANCARIO", r"\bEXTRATO\b", 0.85),
    ("CONTRATO", r"\bCONTRATO\b", 0.85),
    ("PROPOSTA", r"\bPROPOSTA\b", 0.80),
    ("ENCOMENDA", r"\bENCOMENDA\b", 0.80),
]
#: Document types by words of the lower-cased text, first match wins. An invoice's words are
#: looked at in this order too: a receipt, a simplified one, any other. Fixed values.
INVOICE_WORDS = ["fatura", "factura", "invoice"]
KEYWORD_TYPES = [
    ("RECIBO_PAGAMENTO", ["recibo"], 0.65),
    ("DUA_IMPORTACAO", ["dua", "alfândega", "aduaneiro"], 0.80),
    ("GUIA_TRANSPORTE", ["guia de transporte", "guia de remessa"], 0.70),
    ("NOTA_CREDITO", ["nota de crédito", "nota de credito"], 0.70),
    ("NOTA_DEBITO", ["nota de débito", "nota de debito"], 0.70),
    ("EXTRATO_BANCARIO", ["extrato", "bank statement"], 0.75),
    ("CONTRATO", ["contrato", "contract"], 0.65),
    ("ENCOMENDA", ["encomenda", "purchase order"], 0.65),
    ("RECIBO_VENCIMENTO", ["vencimento", "remunera"], 0.70),
]
#: Document types by the code of a fiscal QR payload; other codes are received invoices. Fixed values.
QR_CLASSES = {"FT": "FATURA_RECEBIDA", "FS": "FATURA_SIMPLIFICADA", "FR": "FATURA_RECIBO", "NC": "NOTA_CREDITO", "ND": "NOTA_DEBITO", "RC": "RECIBO_PAGAMENTO"}
LEAST_NAME, LEAST_KEYWORD = 0.8, 0.6
#: Expense categories, and what tells one in a text without accents or case, first match wins. Fixed values.
CATEGORIES = ["Refeições", "Combustível", "Alojamento", "Deslocações", "Material de escritório", "Serviços/FSE", "Comunicações", "Rendas", "Outras"]
CATEGORY_HINTS = [
    ("refei", "Refeições"), ("restaurante", "Refeições"), ("alimentacao", "Refeições"), ("62.2.4", "Refeições"),
    ("combustiv", "Combustível"), ("gasoleo", "Combustível"), ("gasolina", "Combustível"), ("galp", "Combustível"), ("repsol", "Combustível"), ("bp ", "Combustível"), ("62.4.2", "Combustível"),
    ("alojamento", "Alojamento"), ("hotel", "Alojamento"), ("hospedagem", "Alojamento"),
    ("desloca", "Deslocações"), ("viagem", "Deslocações"), ("transporte", "Deslocações"), ("portagem", "Deslocações"), ("estacionamento", "Deslocações"), ("62.4.3", "Deslocações"),
    ("material de escritorio", "Material de escritório"), ("escritorio", "Material de escritório"), ("toner", "Material de escritório"), ("papelaria", "Material de escritório"),
    ("servico", "Serviços/FSE"), ("fse", "Serviços/FSE"), ("honorario", "Serviços/FSE"), ("consultoria", "Serviços/FSE"), ("contabilidade", "Serviços/FSE"), ("62.2.1", "Serviços/FSE"), ("62.2.4", "Serviços/FSE"),
    ("comunicac", "Comunicações"), ("telefone", "Comunicações"), ("internet", "Comunicações"), ("vodafone", "Comunicações"), ("nos comunicac", "Comunicações"), ("meo", "Comunicações"),
    ("renda", "Rendas"), ("arrendamento", "Rendas"),
]
_CLASS = "struct<type:string,confidence:double>"


def _class(kind: str, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))


def name_type(name: Column) -> Column:
    """What the file name tells, however sure."""
    out = F.lit(None).cast(_CLASS)
    for kind, pattern, confidence in reversed(NAME_TYPES):
        out = F.when(F.upper(name).rlike(pattern), _class(kind, confidence)).otherwise(out)
    return out


def name_class(name: Column) -> Column:
    found = name_type(name)
    return F.when(found["confidence"] >= LEAST_NAME, found)


def qr_class(code: Column) -> Column:
    """The class of a fiscal QR payload's type code; null without a code."""
    table = F.create_map(*(F.lit(x) for pair in QR_CLASSES.items() for x in pair))
    kind = F.coalesce(F.try_element_at(table, F.upper(code)), F.lit("FATURA_RECEBIDA"))
    return F.when(F.coalesce(code, F.lit("")) != "", F.struct(kind.alias("type"), F.lit(0.95).alias("confidence")))


def keyword_type(text: Column) -> Column:
    """What the words of a text tell; OUTRO (.3) where they tell nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    out = _class("OUTRO", 0.30)
    for kind, words, confidence in reversed(KEYWORD_TYPES):
        out = F.when(said(words), _class(kind, confidence)).otherwise(out)
    invoice = F.when(said(["recibo"]), _class("FATURA_RECIBO", 0.70)).when(said(["simplificada"]), _class("FATURA_SIMPLIFICADA", 0.75)).otherwise(_class("FATURA_RECEBIDA", 0.65))
    return F.when(said(INVOICE_WORDS), invoice).otherwise(out)


def keyword_class(text: Column) -> Column:
    found = keyword_type(text)
    return F.when(found["confidence"] >= LEAST_KEYWORD, found)


def classified(name: Column, text: Column, code: Column | None = None) -> Column:
    """The file name's class if it is sure enough, else the QR payload's, else the text's, else unidentified."""
    qr = qr_class(code) if code is not None else F.lit(None).cast(_CLASS)
    return F.coalesce(name_class(name), qr, keyword_class(text), _class("UNIDENTIFIED", 0.1))


def expense_category(description: Column) -> Column:
    """The category of the first hint that a description contains; null if it contains none."""
    plain, out = category_key(description), F.lit(None).cast("string")
    for hint, category in reversed(CATEGORY_HINTS):
        out = F.when(F.contains(plain, F.lit(hint)), category).otherwise(out)
    return out


def known_category(name: Column) -> Column:
    return F.coalesce(name.isin(CATEGORIES), F.lit(False))


def filing_folder(date: Column, supplier: Column, category: Column, country: Column, recurring: Column) -> Column:
    """The folder of a document that no rule fits: abroad or at home, of a recurring supplier or
    of a category. At home without either it is null; abroad it is a general folder."""
    month = F.concat(F.lit("/"), F.date_format(date, "yyyy"), F.lit("/"), F.date_format(date, "MM"))
    who, what = path_slug(F.coalesce(supplier, F.lit(""))), category_slug(category)
    regular, told = F.coalesce(recurring, F.lit(False)) & (who != "_"), what != "_"
    abroad = F.when(regular, F.concat(F.lit("/Estrangeiras/Fornecedor/"), who, month)).when(told, F.concat(F.lit("/Estrangeiras/Despesa/"), what, month)).otherwise(F.concat(F.lit("/Estrangeiras/Geral"), month))
    home = F.when(regular, F.concat(F.lit("/Fornecedores/"), who, month)).when(told, F.concat(F.lit("/Despesas/"), what, month))
    return F.when(date.isNotNull(), F.when(origin_label(country) == "Estrangeira", abroad).otherwise(home))


def file_name(supplier: Column, date: Column, number: Column, doc_id: Column, extension: str) -> Column:
    """SUPPLIER_YYYY-MM-DD_NUMBER.ext where all are known, else doc_ID.ext; at most 200 characters."""
    known = F.concat_ws("_", F.upper(file_slug(supplier)), F.date_format(date, "yyyy-MM-dd"), file_slug(number))
    whole = supplier.isNotNull() & date.isNotNull() & number.isNotNull()
    return F.concat(F.left(F.when(whole, known).otherwise(F.concat(F.lit("doc_"), doc_id.cast("string"))), F.lit(200)), F.lit(f".{extension}"))


def first_rule(documents: DataFrame, rules: DataFrame, inbox: str = "Inbox/{Ano}/{Mes}") -> DataFrame:
    """(id, rule_id, folder): the active rule of the largest priority whose present
    conditions all hold (ties by rule id), else the inbox. documents: id, type, supplier,
    nif, email, text, date; rules: id, priority, active, type, supplier, nif, domain,
    keywords, pattern. Rules are a small table that users write; it is broadcast."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    r = F.broadcast(rules.where("active").select(*(F.col(c).alias(f"r_{c}") for c in ("id", "priority", "type", "supplier", "nif", "domain", "keywords", "pattern"))))
    free = lambda c, fits: F.col(f"r_{c}").isNull() | fits
    holds = (
        free("type", F.col("type") == F.col("r_type"))
        & free("supplier", F.contains(low("supplier"), F.lower("r_supplier")))
        & free("nif", F.col("nif") == F.col("r_nif"))
        & free("domain", F.endswith(low("email"), F.concat(F.lit("@"), F.lower("r_domain"))))
        & free("keywords", F.exists("r_keywords", lambda k: F.contains(low("text"), F.lower(k))))
    )
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("r_priority"), "r_id")
    best = documents.join(r, holds, "left").withColumn("k", F.row_number().over(order)).where("k = 1")
    context = {"Ano": F.date_format("date", "yyyy"), "Mes": F.date_format("date", "MM"), "Fornecedor": path_slug(F.coalesce("supplier", F.lit(""))), "Entidade": path_slug(F.coalesce("supplier", F.lit(""))), "Tipo": path_slug(F.coalesce("type", F.lit("")))}
    for token, column in (("Categoria", "category"), ("Pais", "country")):  # documents may lack these columns
        context[token] = path_slug(F.coalesce(column, F.lit(""))) if column in documents.columns else F.lit("_")
    context["Origem"] = origin_label(F.col("country")) if "country" in documents.columns else F.lit("")
    return best.select("id", F.col("r_id").alias("rule_id"), filled(F.coalesce("r_pattern", F.lit(inbox)), context).alias("folder"))


def folders(paths: DataFrame) -> DataFrame:
    """Every folder that paths (column folder) need, with its parent and depth; a closing yyyy/MM is dropped."""
    parts = F.split(F.regexp_replace("folder", r"/\d{4}/\d{2}$", ""), "/")
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), n.alias("depth")))).alias("f"))
    return steps.select("f.path", F.nullif(F.col("f.parent"), F.lit("")).alias("parent"), "f.depth").distinct()


def refiled(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, folder) of documents (id, type, supplier, party_id, category, country, recurring,
    date) whose type, supplier, party or category changed; a new folder of null keeps the old one
    and is no row. Documents that are new are no change."""
    watched = ["type", "supplier", "party_id", "category"]
    old = before.select("id", *(F.col(c).alias(f"__{c}") for c in watched))
    rows = after.join(old, "id").where(reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in watched)))
    folder = filing_folder(F.col("date"), F.col("supplier"), F.col("category"), F.col("country"), F.col("recurring"))
    return rows.select("id", folder.alias("folder")).where("folder IS NOT NULL")


def filing_metadata(metadata: Column, key: str, value: Column) -> Column:
    """A map (of text) with one key set, or without it where value is null; a null map is an empty one."""
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), value)))
