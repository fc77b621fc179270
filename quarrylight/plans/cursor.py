"""Cursors bound to their request: plain and authenticated forms."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from quarrylight.model import invalid

VERSION = 1
MOST_BYTES = 4096


def binding(operation: str, **fields: object) -> str:
    """A digest of the operation and all fields that must stay the same from page to page."""
    h = hashlib.sha256()
    for part in (str(VERSION), operation, *(f"{k}={json.dumps(v, sort_keys=True, ensure_ascii=False)}" for k, v in sorted(fields.items()))):
        data = part.encode("utf-16-be", "surrogatepass")
        h.update(len(data).to_bytes(4, "big") + data)
    return h.hexdigest()


def _pack(body: bytes) -> str:
    return base64.urlsafe_b64encode(body).rstrip(b"=").decode()


def _unpack(token: str) -> bytes:
    if not isinstance(token, str) or len(token) > MOST_BYTES:
        raise invalid("cursor")
    try:
        body = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True)
    except ValueError as e:
        raise invalid("cursor") from e
    if _pack(body) != token:
        raise invalid("cursor")
    return body


def encode(bound: str, position: list, key: bytes | None = None) -> str:
    body = json.dumps([VERSION, bound, position], ensure_ascii=False, separators=(",", ":")).encode()
    return _pack((hmac.new(key, body, hashlib.sha256).digest() if key else b"") + body)


def decode(token: str, bound: str, key: bytes | None = None) -> list:
    """The position of a cursor; it must come from the same request and, with a key, from this process."""
    body = _unpack(token)
    if key:
        mac, body = body[:32], body[32:]
        if not hmac.compare_digest(mac, hmac.new(key, body, hashlib.sha256).digest()):
            raise invalid("cursor")
    try:
        version, own, position = json.loads(body)
    except (ValueError, TypeError) as e:
        raise invalid("cursor") from e
    if version != VERSION or own != bound or not isinstance(position, list):
        raise invalid("cursor")
    return position
