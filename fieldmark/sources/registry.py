"""Client of a REST registry: keyed lookups with retries, slimming, JSON-lines caches."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from . import storage

TRIES, THREADS = 4, 12


def http_get(url: str, timeout: float = 30) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def get_json(url: str, get: Callable[[str], bytes] = http_get, tries: int = TRIES, pause: Callable[[float], None] = time.sleep) -> dict | None:
    """None where the key is unknown (404); other failures are tried again after 1, 2, 4 ... seconds, the last is raised."""
    for attempt in range(tries):
        try:
            return json.loads(get(url))
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
            failure: Exception = error
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as error:
            failure = error
        if attempt + 1 < tries:
            pause(2.0**attempt)
    raise failure


def _clean(text: str | None) -> str | None:
    return (text or "").strip() or None


def slim_dataset(key: str, answer: dict | None) -> dict:
    """The few fields that the dimension needs."""
    a = answer or {}
    return {
        "datasetkey": key,
        "dataset_title": _clean(a.get("title")),
        "dataset_type": a.get("type"),
        "license_url": a.get("license"),
        "publisher_key": a.get("publishingOrganizationKey"),
        "installation_key": a.get("installationKey"),
        "dataset_created": a.get("created"),
        "dataset_modified": a.get("modified"),
        "found": bool(answer),
    }


def slim_organisation(key: str, answer: dict | None) -> dict:
    a = answer or {}
    return {
        "publisher_key": key,
        "publisher_title": _clean(a.get("title")),
        "publisher_country": a.get("country"),
        "publisher_city": _clean(a.get("city")),
        "endorsing_node_key": a.get("endorsingNodeKey"),
        "publisher_datasets": a.get("numPublishedDatasets"),
        "found": bool(answer),
    }


def read_jsonl(path: str) -> list[dict]:
    return [json.loads(x) for x in (storage.read_text(path) or "").split("\n") if x.strip()]


def write_jsonl(path: str, rows: Iterable[dict]) -> None:
    """Replaces the file in one step."""
    storage.write_text(path, "".join(json.dumps(r) + "\n" for r in rows))


def fetch_missing(keys: Iterable[str], cache: str, key_field: str, url: str, slim: Callable[[str, dict | None], dict], get: Callable[[str], bytes] = http_get, refresh: bool = False, pause: Callable[[float], None] = time.sleep) -> list[dict]:
    """The cache, completed by the keys that it lacks; url has a {key}."""
    held = {} if refresh else {r[key_field]: r for r in read_jsonl(cache)}
    missing = sorted({k for k in keys if k} - held.keys())
    with ThreadPoolExecutor(THREADS) as pool:
        new = list(pool.map(lambda k: slim(k, get_json(url.format(key=k), get, pause=pause)), missing))
    rows = [*held.values(), *new]
    if new or refresh:
        write_jsonl(cache, rows)
    return rows
