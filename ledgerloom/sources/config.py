"""Settings and price caches, read on the driver. Whatever is missing or malformed gives defaults."""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
import tomllib
import urllib.request
from dataclasses import dataclass

from ledgerloom.operators.pricing import RATES

log = logging.getLogger(__name__)
Rates = tuple[float, float, float, float, float]


@dataclass(frozen=True)
class Config:
    default_agent: str | None = None

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        path = path or os.environ.get("LEDGERLOOM_CONFIG") or os.path.expanduser("~/.config/ledgerloom/config.toml")
        try:
            with open(path, "rb") as f:
                agent = tomllib.load(f).get("default_agent")
        except FileNotFoundError:
            return cls()
        except (OSError, tomllib.TOMLDecodeError) as e:
            log.warning("settings in %s not read: %s", path, e)
            return cls()
        return cls(agent if isinstance(agent, str) else None)


def greet_once(folder: str | None = None) -> bool:
    """Whether nobody has been welcomed here yet; from now on somebody has. A folder that can't be written to never gets there."""
    folder = folder or os.environ.get("LEDGERLOOM_STATE_DIR") or os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "ledgerloom")
    try:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "greeted"), "x"):
            return True
    except OSError:
        return False


def cache_file() -> str:
    """Where prices are kept: $LEDGERLOOM_PRICES, else below the user's cache folder."""
    return os.environ.get("LEDGERLOOM_PRICES") or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "ledgerloom", "prices.json")


def price_cache(path: str | None = None) -> dict[str, Rates]:
    """Overrides from ``{source, refreshed_at, models: {id: rates}}``; none if there are none."""
    try:
        with open(path or cache_file()) as f:
            models = json.load(f)["models"]
        return {k: tuple(float(v[r]) for r in RATES) for k, v in models.items()}
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return {}


def refresh_prices(source: str, path: str | None = None) -> int:
    """Read a listing (a URL or a file) and keep its prices; their number. Raises if it can't be read or has none."""
    opened = urllib.request.urlopen(source, timeout=20) if "://" in source else open(source, "rb")  # noqa: S310
    with opened as f:
        prices = per_token_prices(json.load(f))
    if not prices:
        raise ValueError(f"no prices in {source}")
    path = path or cache_file()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    kept = {"source": source, "refreshed_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "models": {k: dict(zip(RATES, v, strict=True)) for k, v in prices.items()}}
    with open(f"{path}.new", "w") as f:
        json.dump(kept, f, indent=1)
    os.replace(f"{path}.new", path)
    return len(prices)


def per_token_prices(listing: dict) -> dict[str, Rates]:
    """Rates from a public listing of USD per token. What it leaves out follows from the input rate:
    cache reads a tenth, five-minute writes 1.25 times, and one-hour writes 1.6 times those."""
    out = {}
    for model, x in listing.items():
        if not isinstance(x, dict) or not isinstance(x.get("input_cost_per_token"), (int, float)) or not isinstance(x.get("output_cost_per_token"), (int, float)):
            continue
        i, o = x["input_cost_per_token"] * 1e6, x["output_cost_per_token"] * 1e6
        read, write = x.get("cache_read_input_token_cost"), x.get("cache_creation_input_token_cost")
        five = write * 1e6 if isinstance(write, (int, float)) else 1.25 * i
        out[model] = (i, o, read * 1e6 if isinstance(read, (int, float)) else 0.1 * i, five, 1.6 * five)
    return out
