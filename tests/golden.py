"""Hand-written raw rows that hit every edge the loaders must get right."""

from datetime import datetime
from decimal import Decimal

from kpiloom import schemas

T = datetime
D = Decimal

ROWS = {
    "orders": [
        # more than a calendar day but one 24-hour period
        ("o1", "c1", "delivered", T(2016, 1, 1, 23), T(2016, 1, 3, 1), None),
        # delivered two hours before the purchase
        ("o2", "c2", "delivered", T(2016, 1, 3, 1), T(2016, 1, 2, 23), None),
        # not delivered; no items, payments or reviews
        ("o3", "c3", "shipped", T(2016, 2, 29, 12), None, None),
        # duplicated order id: the earlier purchase is kept
        ("o4", "c1", "canceled", T(2016, 3, 2), None, None),
        ("o4", "c2", "delivered", T(2016, 3, 1), T(2016, 3, 22), None),
        # unknown customer, no purchase time
        ("o5", "cx", "created", None, None, None),
    ],
    "items": [
        ("o1", 1, None, D("10.00"), D("1.00")),  # first product missing
        ("o1", 2, "p2", D("20.50"), D("2.25")),
        ("o1", 3, "p1", None, D("0.25")),
        ("o2", 1, "p1", None, None),  # only NULL prices: zero, not NULL
        ("o4", 2, "p1", D("500.01"), D("3.00")),
        ("o4", 1, "p3", D("0.00"), None),
    ],
    "payments": [
        ("o1", 2, "voucher", 1),
        ("o1", 1, "card", 3),
        ("o2", 1, None, 2),
        ("o2", 2, "boleto", None),
        ("o4", 1, None, None),
    ],
    "reviews": [("o1", 2), ("o1", 3), ("o2", 3), ("o2", 4), ("o4", None)],
    "customers": [
        ("c1", "sao paulo", "SP"),
        ("c2", "lisbon", "PT"),  # state outside the 27 codes
        ("c3", None, None),
        ("c1", "zzz", "RJ"),  # duplicated customer id
    ],
    "products": [
        ("p1", "beleza", 1005.0),
        ("p2", "unknown", 280.0),  # category without a translation
        ("p3", "beleza", None),
        ("p1", "beleza", 1005.0),
    ],
    "translation": [("beleza", "beauty"), ("casa", "home")],
    "employees": [
        (11, "Sales", "Manager", "Yes", "Male", "Yes", 30, D("2500.00"), 1, 2, 3, 4, 1, 3),
        (12, "Sales", "Manager", "No", "Female", "No", 40, D("9000.00"), 4, 9, 1, 2, 4, 3),
        (15, "R&D", "Scientist", "No", "Female", "Yes", 50, D("4000.50"), 3, None, 1, 2, 4, 4),
        (19, None, "Scientist", "Maybe", "Male", "No", 25, None, 3, 1, 1, 2, 4, 4),
    ],
}


def raw_frames(spark):
    return {name: spark.createDataFrame(rows, schemas.RAW[name]) for name, rows in ROWS.items()}
