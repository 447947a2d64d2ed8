"""Errors with a code for machines."""

from __future__ import annotations


class TidemarkError(Exception):
    code = "error"


class InvalidArgument(TidemarkError, ValueError):
    code = "invalid_argument"


class NotFound(TidemarkError, LookupError):
    code = "not_found"


class InvalidData(TidemarkError):
    code = "invalid_data"


class ProviderFailed(TidemarkError):
    code = "provider_failed"


class RateLimited(ProviderFailed):
    code = "rate_limited"


#: Signs of a rate limit in a provider's message (fixed values).
RATE_LIMIT_SIGNS = ("429", "rate limit", "too many requests")


def provider_error(error: Exception, ticker: str) -> ProviderFailed:
    """What a reader raises for an error of its provider."""
    text = str(error).lower()
    kind = RateLimited if any(s in text for s in RATE_LIMIT_SIGNS) else ProviderFailed
    return kind(f"{ticker}: {error}")
