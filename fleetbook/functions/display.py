"""Display text as Column expressions: money, numbers, dates, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetbook.functions.amounts import is_blank

# Display texts of the data model's codes and empty values.
PERIOD_TYPE_LABELS = {"week": "Carga semanal", "day": "Carga diaria"}
BILLING_STATUS_LABELS = {"invoiced": "Facturado", "pending": "Falta facturar"}
ROLE_LABELS = {"admin": "Administrador", "driver": "Chofer"}
ACTIVE_LABELS = {"active": "Activo", "inactive": "Inactivo"}
EMPTY_DASH = "-"
NO_CREATOR = "Sistema"
NO_OBSERVATION = "Sin observacion"
NO_DRIVER = "Sin asignar"
ASSIGNED_TO = " (asignado a {})"
CURRENCY_PREFIX = "$ "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number_ar(value, decimals: int = 2) -> Column:
    """es-AR number text: ``.`` for thousands, ``,`` for decimals.

    Rounded half away from zero on the decimal value first (``format_number``
    alone would round half to even).
    """
    v = F.round(_c(value).cast("decimal(38,6)"), decimals)
    return F.translate(F.format_number(v, decimals), ",.", ".,")


def money(value, decimals: int = 0) -> Column:
    """``$ 1.234.568``."""
    return F.concat(F.lit(CURRENCY_PREFIX), number_ar(value, decimals))


def date_ar(value) -> Column:
    """``dd/mm/yyyy``, or ``-`` when there is no date."""
    return F.coalesce(F.date_format(_c(value), "dd/MM/yyyy"), F.lit(EMPTY_DASH))


def datetime_ar(value) -> Column:
    return F.coalesce(F.date_format(_c(value), "dd/MM/yyyy HH:mm"), F.lit(EMPTY_DASH))


def car_label(brand="brand", model="model", plate="plate") -> Column:
    """``brand model - plate``; NULL if any part is NULL (SQL ``CONCAT``)."""
    return F.concat(_c(brand), F.lit(" "), _c(model), F.lit(" - "), _c(plate))


def fallback(value, text: str) -> Column:
    """``value ?: text``: NULL, empty and ``'0'`` take the fallback."""
    v = _c(value)
    return F.when(is_blank(v), F.lit(text)).otherwise(v.cast("string"))


def label_of(value, labels: dict[str, str]) -> Column:
    """Two-way label: the first key's label on equality, the other label otherwise."""
    (k1, l1), (_, l2) = list(labels.items())
    return F.when(_c(value) == k1, F.lit(l1)).otherwise(F.lit(l2))


def sign_class(value) -> Column:
    return F.when(_c(value) < 0, F.lit("loss")).otherwise(F.lit("gain"))


def next_billing_status(value) -> Column:
    return F.when(_c(value) == "invoiced", F.lit("pending")).otherwise(F.lit("invoiced"))
