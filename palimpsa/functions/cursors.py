"""Page cursors: opaque, bound to the scope they were made for, optionally signed."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json


def scope_hash(scope: object) -> str:
    text = json.dumps(scope, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def encode(scope: object, keys: list, secret: bytes | None = None) -> str:
    body = json.dumps([scope_hash(scope), keys], ensure_ascii=False, separators=(",", ":")).encode()
    mark = hmac.new(secret, body, hashlib.sha256).digest() if secret else b""
    return base64.urlsafe_b64encode(mark + body).decode().rstrip("=")


def decode(scope: object, cursor: str, secret: bytes | None = None) -> list:
    """The keys of a cursor; ValueError if it is broken, forged or of another scope."""
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
        mark, body = (raw[:32], raw[32:]) if secret else (b"", raw)
        if secret and not hmac.compare_digest(mark, hmac.new(secret, body, hashlib.sha256).digest()):
            raise ValueError("the cursor is not ours")
        own, keys = json.loads(body)
    except (ValueError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if own != scope_hash(scope):
        raise ValueError("the cursor belongs to another scope")
    return keys
