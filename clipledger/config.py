"""Default limits. Every operator takes these as parameters."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class Limits:
    # sizes
    max_upload_bytes: int = 8 * MIB
    max_download_bytes: int = 500 * MIB
    buffer_bytes: int = 8 * MIB
    min_free_bytes: int = 500 * MIB
    attachment_window_bytes: int = 64 * MIB
    # encoding budget
    container_overhead: float = 0.03
    vbr_margin: float = 0.05
    target_ratio: float = 0.85
    split_ratio: float = 0.80
    audio_padding: float = 1.1
    min_kbps: int = 400
    max_segment_s: int = 120
    preset: str = "fast"
    backend: str = "none"
    default_duration_s: float = 60.0
    # timeouts, seconds
    download_timeout_s: int = 60
    upload_timeout_s: int = 120
    encode_timeout_s: int = 600
    # admission
    dedup_ttl_s: int = 86_400
    user_limit: int = 10
    user_window_s: int = 60
    channel_limit: int = 20
    channel_window_s: int = 60
    positive_ttl_s: int = 300
    negative_ttl_s: int = 60
    # uploads
    parts_per_request: int = 10
    prepare_concurrency: int = 4
    batch_uploads: bool = True
    max_retries: int = 3
    # misc
    transcode_concurrency: int = 1
    parallel_segments: int = 4
    max_redirects: int = 5
    debounce_s: int = 3
    queue_capacity: int = 100
    queue_warn: int = 80
    prune_batch: int = 500
    clock_skew_s: int = 60

    @property
    def inflight_ttl_s(self) -> int:
        """How long an unfinished job may hold its key."""
        whole = self.download_timeout_s + self.encode_timeout_s + self.upload_timeout_s
        return max(whole, 2 * self.encode_timeout_s) + 60


DEFAULTS = Limits()
