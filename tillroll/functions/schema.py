"""Header normalisation and validation for retail line items (plan-time only)."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The canonical retail columns, in the order the data model uses.
REQUIRED_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity",
                    "InvoiceDate", "UnitPrice", "CustomerID"]

# Header aliases per canonical column, matched after lower-casing
# and deleting "_", " " and "-".
HEADER_ALIASES = {
    "InvoiceNo": ["invoiceno", "invoice", "invoicenumber", "invno"],
    "StockCode": ["stockcode", "itemcode", "productcode", "sku", "code"],
    "Description": ["description", "desc", "itemdescription", "productname", "item", "product"],
    "Quantity": ["quantity", "qty", "units", "count", "amount"],
    "InvoiceDate": ["invoicedate", "date", "timestamp", "transactiondate", "time"],
    "UnitPrice": ["unitprice", "price", "rate", "itemprice", "cost"],
    "CustomerID": ["customerid", "customer", "userid", "clientid", "custid", "user"],
}

# Cell texts read as missing (the usual CSV missing-value tokens).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]


def _norm(name: str) -> str:
    return name.strip().lower().replace("_", "").replace(" ", "").replace("-", "")


_LOOKUP = {alias: canon for canon, aliases in HEADER_ALIASES.items() for alias in aliases}


def canonical_name(name: str) -> str:
    """Canonical column for a header, or the stripped header itself."""
    return _LOOKUP.get(_norm(name), name.strip())


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim headers and rename aliases to the canonical retail names.

    Pure plan-time renaming (no job). Two headers landing on one canonical name
    raise instead of producing duplicate columns.
    """
    targets = [canonical_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for src, dst in zip(df.columns, targets):
        if dst in seen:
            raise ValueError(
                f"Columns {seen[dst]!r} and {src!r} both map to {dst!r}; keep only one.")
        seen[dst] = src
    return df.toDF(*targets)


def validate_columns(df: DataFrame) -> DataFrame:
    """Raise ``ValueError`` naming every required column that is missing."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(
            f"no column for {', '.join(missing)}; a retail table has {', '.join(REQUIRED_COLUMNS)}")
    return df
