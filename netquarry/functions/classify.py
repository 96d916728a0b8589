"""Host name to application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Applications in order of precedence, each with the substrings of a lower-cased name that tell it.
APP_PATTERNS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Google", ("google", "gstatic", "googleapis", "ggpht", "gvt1")),
    ("YouTube", ("youtube", "ytimg", "youtu.be", "yt3.ggpht")),
    ("Facebook", ("facebook", "fbcdn", "fb.com", "fbsbx", "meta.com")),
    ("Instagram", ("instagram", "cdninstagram")),
    ("WhatsApp", ("whatsapp", "wa.me")),
    ("Twitter/X", ("twitter", "twimg", "x.com", "t.co")),
    ("Netflix", ("netflix", "nflxvideo", "nflximg")),
    ("Amazon", ("amazon", "amazonaws", "cloudfront", "aws")),
    ("Microsoft", ("microsoft", "msn.com", "office", "azure", "live.com", "outlook", "bing")),
    ("Apple", ("apple", "icloud", "mzstatic", "itunes")),
    ("Telegram", ("telegram", "t.me")),
    ("TikTok", ("tiktok", "tiktokcdn", "musical.ly", "bytedance")),
    ("Spotify", ("spotify", "scdn.co")),
    ("Zoom", ("zoom",)),
    ("Discord", ("discord", "discordapp")),
    ("GitHub", ("github", "githubusercontent")),
    ("Cloudflare", ("cloudflare", "cf-")),
)
# The names that a rule can give.
APP_NAMES = ("Unknown", "HTTP", "HTTPS", "DNS", "TLS", "QUIC", *(name for name, _ in APP_PATTERNS))


def app_of(host: Column) -> Column:
    """First application whose pattern the name holds; Unknown without a name, HTTPS for any other name."""
    name = F.lower(host)
    found = F.when(F.coalesce(host, F.lit("")) == "", "Unknown")
    for app, patterns in APP_PATTERNS:
        found = found.when(reduce(lambda a, b: a | b, (F.contains(name, F.lit(p)) for p in patterns)), app)
    return found.otherwise("HTTPS")


def app_named(name: Column) -> Column:
    """An application by its name in any case; Unknown for other names."""
    found = F.when(F.lower(name) == APP_NAMES[0].lower(), APP_NAMES[0])
    for app in APP_NAMES[1:]:
        found = found.when(F.lower(name) == app.lower(), app)
    return found.otherwise("Unknown")


def app_name(name: str) -> str:
    """``app_named`` of a Python string."""
    return next((app for app in APP_NAMES if app.lower() == name.lower()), "Unknown")


def app_of_name(host: str) -> str:
    """``app_of`` of a Python string."""
    name = host.lower()
    return next((app for app, patterns in APP_PATTERNS if any(p in name for p in patterns)), "HTTPS") if host else "Unknown"
