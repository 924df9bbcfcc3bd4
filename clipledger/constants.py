"""Word lists, patterns and tables that results depend on."""

# --- post links -----------------------------------------------------------
LINK_PATTERN = (
    r"https?://(?:(?:www\.|mobile\.)?(?:twitter\.com|x\.com)"
    r"|(?:fxtwitter\.com|vxtwitter\.com|fixupx\.com|twittpr\.com))"
    r"/([A-Za-z0-9_]{1,15})/status/(\p{Nd}+)"
)
CANONICAL_PREFIX = "https://x.com/"
MAX_U64 = "18446744073709551615"

# --- media ----------------------------------------------------------------
EXTENSIONS = ["mp4", "webm", "mov", "mkv", "avi", "ts", "gif", "jpg", "jpeg", "png", "webp"]
INFERRED_EXTENSIONS = ["mp4", "webm", "gif", "jpg", "jpeg", "png", "webp"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif"]
CONTAINER_BY_EXTENSION = {
    "mp4": "mp4", "mov": "mov", "webm": "webm", "mkv": "matroska",
    "avi": "avi", "ts": "mpegts", "gif": "gif",
}
CONTAINER_BY_PROBE_NAME = {
    "mp4": "mp4", "m4a": "mp4", "3gp": "mp4", "3g2": "mp4", "mj2": "mp4",
    "mov": "mov", "webm": "webm", "matroska": "matroska",
    "avi": "avi", "mpegts": "mpegts", "gif": "gif",
}
VIDEO_CODECS = {"h264": "h264", "hevc": "h265", "h265": "h265", "vp8": "vp8", "vp9": "vp9", "av1": "av1"}
AUDIO_CODECS = {"aac": "aac", "opus": "opus", "vorbis": "vorbis", "mp3": "mp3"}
MEDIA_PRIORITY = {"video": 0, "gif": 1, "image": 2, "photo": 2}

# --- URL and address policy -----------------------------------------------
LOCAL_SUFFIXES = [".local", ".internal", ".arpa", ".corp", ".home", ".lan"]
MEDIA_HOSTS = ["pbs.twimg.com", "video.twimg.com", "api.vxtwitter.com", "abs.twimg.com"]
MEDIA_HOST_SUFFIX = ".twimg.com"
ALLOWED_PORTS = [443, 8443]
# private, loopback, link-local, multicast, unspecified, broadcast
BLOCKED_V4 = [
    "0.0.0.0/32", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.168.0.0/16", "224.0.0.0/4", "255.255.255.255/32",
]
# v4-compatible (holds unspecified and loopback), v4-mapped, unique-local, link-local, multicast
BLOCKED_V6 = ["::/96", "::ffff:0:0/96", "fc00::/7", "fe80::/10", "ff00::/8"]

# --- failures --------------------------------------------------------------
TRUNCATION_WORDS = ["eof", "unexpected end", "unterminated", "truncated", "partial"]
TRANSIENT_WORDS = [
    "timed out", "timeout", "rate limit", "429", "network", "connection", "temporar", "server",
]
DURABLE_WORDS = ["private", "protected", "not found", "no media", "unavailable", "does not exist"]
HW_FAILURE_PATTERNS = [
    ("nvenc", "nvenc"), ("nvenc", "cuda"), ("nvenc", "hwaccel"),
    ("vaapi", "vaapi"), ("vaapi", "hwaccel"),
    ("videotoolbox", "videotoolbox"), ("videotoolbox", "hwaccel"),
    ("qsv", "qsv"), ("qsv", "mfx"), ("qsv", "hwaccel"),
    ("amf", "amf"), ("amf", "hwaccel"),
]
# (error kind, source kind or None for any, message, notify)
ERROR_MESSAGES = [
    ("duplicate", None, "this tweet was already archived recently.", False),
    ("resolve_failed", None,
     "could not extract media from tweet. the tweet may be protected, deleted, or contain no media.", True),
    ("download_failed", "ssrf_blocked", "the media URL was blocked for security reasons.", True),
    ("download_failed", None, "failed to download media. please try again later.", True),
    ("transcode_failed", None, "failed to process media for upload.", True),
    ("timeout", None, "operation timed out. the media may be too large or the service is slow.", True),
    ("disk_space", None, "not enough disk space to process the media.", True),
    ("io", None, "an internal error occurred.", True),
    ("upload_failed", None, "failed to upload media to Discord.", True),
    ("discord_api", None, "an internal error occurred.", True),
]
ERROR_CATEGORIES = [
    "resolve_failed", "download_failed", "ssrf_blocked",
    "optimize_failed", "upload_failed", "progress_update_errors",
]

# --- stages ----------------------------------------------------------------
STAGES = ["resolve", "download", "optimize", "upload"]
STAGE_THRESHOLDS_MS = [
    ("resolve", 8_000), ("download", 20_000), ("optimize", 30_000), ("upload", 20_000), ("job", 45_000),
]
PERMITS = [("download", 4), ("upload", 2), ("transcode", 1), ("fallback_resolver", 1), ("pipeline", 8)]
UPLOAD_STAGES = ["attachment_preparation", "http_send", "response_parsing", "post_upload_cleanup"]

# --- encoding ---------------------------------------------------------------
# (short edge, least video kbps), highest first
TIERS = [(2160, 8000), (1440, 4000), (1080, 2000), (720, 1000), (480, 400), (360, 150), (240, 100)]
# size ratio below the bound -> scales (outer) and qualities (inner); last row has no bound
IMAGE_GRID = [
    (1.2, [1.0], [85, 75]),
    (2.0, [1.0, 0.85], [75, 65, 50]),
    (None, [0.85, 0.65, 0.5], [65, 50, 35]),
]

# --- process logs -----------------------------------------------------------
LOG_LINE_BYTES = 4096
LOG_TAIL_ERROR = 10
LOG_TAIL_SUCCESS = 20
