"""Canonical columns and the resolution of physical headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Source headers accepted for each canonical column, first present wins.
HEADER_CANDIDATES: dict[str, list[str]] = {
    "client_id": ["Cpt Client", "Compte Client", "Client", "Code Client"],
    "client_name": ["Intitulé", "Nom Client", "Nom"],
    "invoice_date": ["Date Fact.", "Date_Ref", "Date", "Date facture", "Date Facture"],
    "order_date": ["Date Cde", "Date Commande"],
    "ship_date": ["Date Exp.", "Date Livraison", "Date Expédition"],
    "planned_date": ["Delai Prev"],
    "article_code": ["Code Artic", "Article"],
    "label_1": ["Libelle 1", "Libellé 1", "Désignation", "Designation"],
    "label_2": ["Libelle 2", "Libellé 2"],
    "family": ["Famille Produits", "Famille", "Famille Prod.", "Famille 1"],
    "amount": ["Montant", "CA", "CA Net", "Montant EUR"],
    "qty": ["Quantité", "Quantite", "Qty", "Qte", "Qté", "Quantity"],
    "unit_price": ["PU Net", "Prix Unitaire"],
    "currency": ["Nom Devise", "Devise", "Currency"],
    "order_id": ["N° Bon", "No Bon", "N Bon", "Num Bon", "Numéro Bon", "N° Commande"],
    "country": ["Country", "COUNTRY", "Pays", "PAYS"],
}

# Columns of the cleaned table, in output order.
CLEAN_COLUMNS = [
    "invoice_date", "order_date", "ship_date", "ref_date", "year", "fiscal_year",
    "fiscal_year_label", "month", "fiscal_quarter_code", "weekday", "fiscal_quarter_num",
    "fiscal_quarter_label", "client_id", "client_name", "country", "recipe_code", "label_1",
    "label_2", "family", "amount", "unit_price", "qty", "currency", "order_id",
    "lead_time_days", "planned_days", "lead_time_deviation",
]


def resolve_columns(
    df: DataFrame, candidates: dict[str, list[str]] | None = None, ignore_case: bool = False
) -> DataFrame:
    """Select canonical columns; the first candidate header present wins.

    A role whose headers are all absent becomes a typed null.  Only the schema
    is looked at, no data is read.
    """
    fold = (lambda s: s.upper()) if ignore_case else (lambda s: s)
    present = {}
    for name in df.columns:
        present.setdefault(fold(name), name)
    chosen = []
    for role, headers in (candidates or HEADER_CANDIDATES).items():
        found = next((present[fold(h)] for h in [*headers, role] if fold(h) in present), None)
        source = F.col(f"`{found}`") if found else F.lit(None).cast("string")
        chosen.append(source.alias(role))
    return df.select(*chosen)
