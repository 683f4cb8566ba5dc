"""Domains and thresholds of duplicate detection."""

# Extensions by category.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "heic", "heif", "avif", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "pef", "srw", "x3f", "raw", "jxl", "ico", "psd")
VIDEOS = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "mpg", "mpeg", "3gp", "vob", "ts", "mts", "m2ts", "divx", "rmvb", "asf", "ogv")
AUDIO = ("mp3", "m4a", "wav", "flac", "ogg", "aac", "wma", "opus", "aiff", "aif", "alac", "ape", "dsd", "dsf", "mid", "midi", "amr", "au", "caf")
DOCUMENTS = ("pdf", "doc", "docx", "rtf", "odt", "txt", "md", "xls", "xlsx", "csv", "ods", "tsv", "ppt", "pptx", "odp", "key", "epub", "mobi", "azw", "azw3", "djvu", "html", "htm", "xml", "json")
ARCHIVES = ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "tgz", "tbz2", "lzma", "cab", "iso", "dmg")
EXECUTABLES = ("exe", "bat", "cmd", "com", "scr", "ps1", "psm1", "vbs", "vbe", "js", "jse", "wsf", "wsh", "msi", "msp", "hta", "cpl", "jar", "lnk", "pif", "reg", "sh", "app", "command")
CATEGORIES = {"images": IMAGES, "videos": VIDEOS, "audio": AUDIO, "documents": DOCUMENTS, "archives": ARCHIVES}

# Strategies, and the hashes that a mode needs.
STRATEGIES = ("highest_res", "largest", "oldest", "newest", "prefer_dir")
MODES = {"exact": ("md5",), "quick": ("md5", "dhash"), "standard": ("md5", "phash"), "robust": ("md5", "dhash", "ahash"), "smart": ("md5", "dhash", "ahash", "phash")}

# Thresholds.
PARTIAL_THRESHOLD, PARTIAL_CHUNK = 1 << 20, 64 << 10
FRAMES, SIGNATURE_BINS, LONG_VIDEO_SECONDS = 8, 64, 300
COSINE_LEAST, SIZE_TOLERANCE = 0.9995, 0.02
THUMB_PIXELS, LEAST_AUDIO_WORDS, AUDIO_DEFAULT = 240, 10, 0.80


def extensions(category: str) -> list[str] | tuple[str, ...]:
    """Extensions of a category; ``all`` is their union, an unknown one means images."""
    if category == "all":
        return sorted(set().union(*CATEGORIES.values()))
    return CATEGORIES.get(category, IMAGES)


def mode_hashes(mode: str, category: str = "images") -> tuple[str, ...]:
    """Hashes of a mode: other categories than images compare content alone; visual and acoustic have their own; unknown is quick."""
    if mode in ("visual", "acoustic"):
        return ()
    return MODES.get(mode, MODES["quick"]) if category in ("images", "all") else ("md5",)


def clamped(mode: str, threshold: float) -> float:
    """A threshold within its range: bits 0 to 20, or percent 0 to 100 for acoustic scans."""
    return min(max(threshold, 0), 100 if mode == "acoustic" else 20)


def audio_least(threshold: float) -> float:
    """Least similarity of audio by a threshold in percent; the default if it is out of range."""
    return threshold / 100 if 0 < threshold <= 100 else AUDIO_DEFAULT


def may_open(name: str) -> bool:
    """Whether a file may be handed to the desktop: nothing that would run."""
    return name.rsplit(".", 1)[-1].lower() not in EXECUTABLES if "." in name else True
