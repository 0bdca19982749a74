"""Column helpers built from JVM-side expressions only."""

from .digest import hmac_sha256
from .paths import (basename_image, file_extension, is_suspicious_path, normalize_path, path_lineage,
                    short_extension)
from .risk import benign_technique, logit, low_activity, risk_band, sigmoid
from .text import contains_ci, escape_like, first_truthy, ilike_escaped, keyword_hit, pid_from_key
from .times import (colon_date, date_year, display_timestamp, epoch_date, seconds_between, time_floor)

__all__ = [
    "basename_image", "benign_technique", "colon_date", "contains_ci", "date_year", "display_timestamp",
    "epoch_date", "escape_like", "file_extension", "first_truthy", "hmac_sha256", "ilike_escaped",
    "is_suspicious_path", "keyword_hit", "logit", "low_activity", "normalize_path", "path_lineage",
    "pid_from_key", "risk_band", "seconds_between", "short_extension", "sigmoid", "time_floor",
]
