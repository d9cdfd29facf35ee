"""Small hand-made shops."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from marquee.sources.shop import Shop

COLUMNS = {
    "rental": "rental_id int, rental_date timestamp_ntz, inventory_id int, customer_id int, "
    "return_date timestamp_ntz, staff_id int",
    "payment": "payment_id int, customer_id int, staff_id int, rental_id int, amount decimal(18,2), "
    "payment_date timestamp_ntz",
    "inventory": "inventory_id int, film_id int, store_id int",
    "film": "film_id int, title string, description string, rental_duration int, "
    "rental_rate decimal(4,2), length int, replacement_cost decimal(5,2), rating string",
    "category": "category_id int, name string",
    "film_category": "film_id int, category_id int",
    "film_actor": "actor_id int, film_id int",
    "actor": "actor_id int, first_name string, last_name string",
    "customer": "customer_id int, store_id int, first_name string, last_name string, address_id int, "
    "activebool boolean",
    "staff": "staff_id int, first_name string, last_name string, address_id int, store_id int",
    "store": "store_id int, manager_staff_id int, address_id int",
    "address": "address_id int, address string, postal_code string, phone string, city_id int",
    "city": "city_id int, city string, country_id int",
    "country": "country_id int, country string",
}


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def frame(spark, data: list, ddl: str):
    """A DataFrame held in the plan itself, which keeps small tests quick."""
    schema = _parse_datatype_string(ddl)
    columns = list(zip(*data)) or [[] for _ in schema.names]
    arrays = [
        pa.array(list(values), type=to_arrow_type(field.dataType))
        for values, field in zip(columns, schema.fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def shop(spark, **tables) -> Shop:
    """Tables not given are empty."""
    return Shop.from_frames(
        spark, **{name: frame(spark, tables.get(name, []), ddl) for name, ddl in COLUMNS.items()}
    )


def rental(number: int, customer: int, date: str | datetime, copy: int | None = None, returned=None):
    moment = at(date) if isinstance(date, str) else date
    return (number, moment, copy, customer, at(returned) if isinstance(returned, str) else returned, 1)


def payment(number: int, rental_id: int, amount: str, customer: int = 1, date: str = "2005-01-01"):
    return (number, customer, 1, rental_id, Decimal(amount), at(date))


def film(number: int, title: str, rate: str = "0.99", duration: int = 3, cost: str = "9.99"):
    return (number, title, f"about {title}", duration, Decimal(rate), 90, Decimal(cost), "G")


def rows(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def by(df, key: str) -> dict:
    return {row[key]: row for row in rows(df)}


def days(count: float) -> timedelta:
    return timedelta(days=count)
