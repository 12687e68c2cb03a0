import json
import random

import pytest

from factweave.functions.extract import extract, nanos
from factweave.functions.values import number_text


@pytest.mark.parametrize("x", [0.1, 7.25, -3.5, 99999.5, 0.00025, 12.0, 640.0, -81.0])
def test_plain_numbers_read_back(x):
    text = number_text(x)
    assert float(text) == x and "e" not in text and not text.endswith(".0")


@pytest.mark.parametrize("x", [2.5e6, 3e-7, 6.02e23, -4e9, 7e-320])
def test_numbers_with_exponents_read_back(x):
    mantissa, _, exponent = number_text(x).partition("e")
    assert float(number_text(x)) == x and exponent[0] in "+-" and len(exponent) >= 3 and 1 <= abs(float(mantissa)) < 10


def test_numbers_at_the_edges():
    assert [number_text(x) for x in (999999.0, 1000000.0, 0.0001, 0.00009, float("nan"), float("inf"), float("-inf"), -0.0, None)] == ["999999", "1e+06", "0.0001", "9e-05", "NaN", "+Inf", "-Inf", "-0", None]


def terms_by_hand(value, key, terms, numbers):
    """Every leaf below ``key``: its text alone, and with the nearest key; numbers by that key too."""
    if isinstance(value, dict):
        for k, v in value.items():
            terms_by_hand(v, k, terms, numbers)
    elif isinstance(value, list):
        for v in value:
            terms_by_hand(v, key, terms, numbers)
    elif value is not None:
        text = "true" if value is True else "false" if value is False else number_text(value) if isinstance(value, (int, float)) else value
        terms |= {f"{key}:{text}"} | ({text} if text else set())
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            numbers.append((key, float(value)))


def tree(rnd, depth):
    if depth and rnd.random() < 0.5:
        return {rnd.choice("pqrst") + str(rnd.randrange(3)): tree(rnd, depth - 1) for _ in range(rnd.randrange(4))} if rnd.random() < 0.6 else [tree(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return rnd.choice([None, True, False, "", "leaf", "Öl", rnd.randrange(-50, 50), round(rnd.uniform(-9, 9), 3), 3e8])


def test_terms_as_by_hand():
    rnd = random.Random(71)
    for _ in range(300):
        doc = {f"key{i}": tree(rnd, 3) for i in range(rnd.randrange(5))}
        terms, numbers = set(), []
        terms_by_hand(doc, "", terms, numbers)
        assert extract(json.dumps(doc)) == (sorted(terms), sorted(set(numbers))) or extract(json.dumps(doc)) == (sorted(terms), sorted(numbers))


def test_nothing_in_nothing():
    assert extract("") == ([], []) and extract('{"greenhouse":{"bench":null}}') == ([], [])


@pytest.mark.parametrize("doc", ["[]", '["moss"]', '"moss"', "3.5", "false", '{"moss":', "moss"])
def test_only_objects(doc):
    with pytest.raises(ValueError):
        extract(doc)


def test_times():
    assert nanos(2500.0) == 2500 and nanos(77) == 77
    assert nanos("1970-01-02T00:00:00Z") == 86_400 * 10**9
    assert nanos("1970-01-01T02:30:00+02:30") == 0 and nanos("1969-12-31T23:59:59Z") == -(10**9)
    assert nanos("1970-01-01T00:00:07.25Z") == 7_250_000_000 and nanos("1970-01-01T00:00:00.000000001Z") == 1
    assert [nanos(x) for x in ("noon", "1970-01-01", "1970-01-01T00:00:00", False, None, [], float("inf"))] == [None] * 7
