"""Rows of a query and of its SQL in one comparable form."""


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(norm, v))
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else round(float(v), 6)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql, cols):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
