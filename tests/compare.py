"""Rows of two engines in one comparable form."""

from __future__ import annotations

import datetime
import decimal


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (float, decimal.Decimal)):
        return int(x) if x == int(x) else round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(df, *columns):
    names = columns or sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)


def oracle_rows(connection, sql, columns):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == list(columns)
    order = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
