"""A vendor for tests: BAD always fails, FLAKY fails twice, NONE has no rows."""

import datetime as dt
import os


def bars(symbol, start, end):
    folder = os.environ.get("VENDOR_STUB_CALLS") or "/tmp/vendor-stub"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{symbol}", "a") as f:
        f.write(f"{start} {end}\n")
    with open(f"{folder}/{symbol}") as f:
        calls = len(f.readlines())
    if symbol == "BAD" or symbol == "FLAKY" and calls < 3:
        raise OSError(f"{symbol} is down")
    if symbol == "NONE":
        return []
    return [(dt.date(2024, 1, d), 1.0, 2.0, 0.5, 1.0 + d, 100 * d) for d in range(1, 11)]
