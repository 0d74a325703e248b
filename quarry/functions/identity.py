"""Identity of rows in plain Python, equal to quarry.functions.text.stable_id."""

from __future__ import annotations

import hashlib


def stable_id(*parts: object) -> str:
    digest = hashlib.sha256()
    for part in parts:
        data = str(part).encode()
        digest.update(len(data).to_bytes(4, "big") + data)
    return digest.hexdigest()
