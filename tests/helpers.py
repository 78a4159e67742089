import datetime as dt


def d(text):
    return dt.date.fromisoformat(text) if text else None


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in picked.collect())


def approx(a, b, tol=1e-9):
    return a is not None and abs(a - b) <= tol


def bars(spark, closes, symbol="A", start="2024-01-01", spread=1.0, volume=1000, business=False):
    day, out = d(start), []
    for c in closes:
        while business and day.weekday() > 4:
            day += dt.timedelta(days=1)
        out.append((symbol, day, c, c + spread, c - spread, c, c, volume))
        day += dt.timedelta(days=1)
    return spark.createDataFrame([(s, x, float(o), float(h), float(l), float(c), float(a), v) for s, x, o, h, l, c, a, v in out],
                                 "symbol string, date date, open double, high double, low double, close double, adj_close double, volume long")
