"""Declared tables of the rental shop: columns, types and rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {
    "int": T.IntegerType(),
    "small": T.ShortType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "text": T.StringType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "time": T.TimestampNTZType(),
    "bytes": T.BinaryType(),
    "texts": T.ArrayType(T.StringType()),
    "tokens": T.ArrayType(T.StringType()),
    "rate": T.DecimalType(4, 2),
    "money": T.DecimalType(5, 2),
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str  # key of TYPES
    required: bool = False
    length: int | None = None  # longest text allowed
    padded: bool = False  # stored blank-padded to ``length``


@dataclass(frozen=True)
class Table:
    columns: tuple[Column, ...]
    key: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.kind], True) for c in self.columns])

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required]

    @property
    def lengths(self) -> dict[str, int]:
        return {c.name: c.length for c in self.columns if c.length}


def define_table(key: str, columns: str) -> Table:
    """Columns are written ``name kind[(length)][!]``; ``!`` is NOT NULL."""
    parsed = []
    for item in columns.split(","):
        name, kind = item.split()
        required = kind.endswith("!")
        kind = kind.removesuffix("!")
        length = None
        if "(" in kind:
            kind, size = kind.removesuffix(")").split("(")
            length = int(size)
        parsed.append(
            Column(name, kind.replace("char", "text"), required, length, padded=kind == "char")
        )
    return Table(tuple(parsed), tuple(key.split()))


# The shop's schema.
TABLES = {
    "actor": define_table(
        "actor_id",
        "actor_id int!, first_name text(45)!, last_name text(45)!, last_update time!",
    ),
    "address": define_table(
        "address_id",
        "address_id int!, address text(50)!, address2 text(50), district text(20)!, city_id small!, "
        "postal_code text(10), phone text(20)!, last_update time!",
    ),
    "category": define_table("category_id", "category_id int!, name text(25)!, last_update time!"),
    "city": define_table(
        "city_id", "city_id int!, city text(50)!, country_id small!, last_update time!"
    ),
    "country": define_table("country_id", "country_id int!, country text(50)!, last_update time!"),
    "customer": define_table(
        "customer_id",
        "customer_id int!, store_id small!, first_name text(45)!, last_name text(45)!, email text(50), "
        "address_id small!, activebool bool!, create_date date!, last_update time, active int",
    ),
    "film": define_table(
        "film_id",
        "film_id int!, title text(255)!, description text, release_year int, language_id small!, "
        "rental_duration small!, rental_rate rate!, length small, replacement_cost money!, rating text, "
        "last_update time!, special_features texts, fulltext tokens!",
    ),
    "film_actor": define_table("actor_id film_id", "actor_id small!, film_id small!, last_update time!"),
    "film_category": define_table(
        "film_id category_id", "film_id small!, category_id small!, last_update time!"
    ),
    "inventory": define_table(
        "inventory_id", "inventory_id int!, film_id small!, store_id small!, last_update time!"
    ),
    "language": define_table("language_id", "language_id int!, name char(20)!, last_update time!"),
    "payment": define_table(
        "payment_id",
        "payment_id int!, customer_id small!, staff_id small!, rental_id int!, amount money!, "
        "payment_date time!",
    ),
    "rental": define_table(
        "rental_id",
        "rental_id int!, rental_date time!, inventory_id int!, customer_id small!, return_date time, "
        "staff_id small!, last_update time!",
    ),
    "staff": define_table(
        "staff_id",
        "staff_id int!, first_name text(45)!, last_name text(45)!, address_id small!, email text(50), "
        "store_id small!, active bool!, username text(16)!, password text(40), last_update time!, "
        "picture bytes",
    ),
    "store": define_table(
        "store_id", "store_id int!, manager_staff_id small!, address_id small!, last_update time!"
    ),
}

# Unique column sets beside the keys.
UNIQUE = {
    "store": [("manager_staff_id",)],
    "rental": [("rental_date", "inventory_id", "customer_id")],
}

# Child table, child column, parent table. The parent column is the parent's key.
FOREIGN_KEYS = [
    ("customer", "address_id", "address"),
    ("film_actor", "actor_id", "actor"),
    ("film_actor", "film_id", "film"),
    ("film_category", "category_id", "category"),
    ("film_category", "film_id", "film"),
    ("film", "language_id", "language"),
    ("address", "city_id", "city"),
    ("city", "country_id", "country"),
    ("inventory", "film_id", "film"),
    ("payment", "customer_id", "customer"),
    ("payment", "rental_id", "rental"),
    ("payment", "staff_id", "staff"),
    ("rental", "customer_id", "customer"),
    ("rental", "inventory_id", "inventory"),
    ("rental", "staff_id", "staff"),
    ("staff", "address_id", "address"),
    ("store", "address_id", "address"),
    ("store", "manager_staff_id", "staff"),
]

# Ratings in their own order, and the range of a release year.
RATINGS = ["G", "PG", "PG-13", "R", "NC-17"]
YEARS = (1901, 2155)

# Column defaults ("now" is the load time); every table that keeps its last update has one for it.
DEFAULTS = {
    "customer": {"activebool": True, "create_date": "now"},
    "film": {"rental_duration": 3, "rental_rate": "4.99", "replacement_cost": "19.99", "rating": "G"},
    "staff": {"active": True},
}
for _name, _table in TABLES.items():
    if any(column.name == "last_update" for column in _table.columns):
        DEFAULTS.setdefault(_name, {})["last_update"] = "now"
