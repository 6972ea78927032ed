"""SQL fragments used in many oracle texts."""


def cents_sum(c: str) -> str:
    return f"CAST(sum(CAST(round(({c})*100) AS BIGINT)) AS DOUBLE)"


def money_sum(c: str) -> str:
    return f"{cents_sum(c)}/100"


def money_mean(c: str) -> str:
    return f"{cents_sum(c)}/count({c})/100"


def dev(c: str) -> str:
    return f"round(stddev_samp({c}), 4)"


def half_up(c: str, scale: int = 2) -> str:
    """Half away from zero: the shifted decimal plus or minus a half, cut to a whole number."""
    unit = 10 ** scale
    wide = f"CAST({c} AS DECIMAL(38,10)) * {unit}"
    return f"CAST(trunc({wide} + 0.5 * sign({c})) AS DOUBLE)/{unit}"


def rounded_ratio(num: str, den: str, scale: int) -> str:
    """Whole non-negative num / den, rounded half up, by integer division."""
    unit = 10 ** scale
    return f"CAST((2*CAST({num} AS HUGEINT)*{unit} + {den}) // (2*{den}) AS DOUBLE)/{unit}"


def described(table: str, column: str, mean: str | None = None) -> str:
    mean = mean or f"avg({column})"
    parts = {"count": f"CAST(count({column}) AS DOUBLE)", "mean": mean,
             "stddev": dev(column), "min": f"CAST(min({column}) AS DOUBLE)",
             "max": f"CAST(max({column}) AS DOUBLE)"}
    return "\nUNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{m}' AS metric, {e} AS value FROM {table}"
        for m, e in parts.items())
