"""Names, patterns and limits that results depend on."""

from __future__ import annotations

# --- inference limits -------------------------------------------------------
GUESS_LIMIT = 7
GUESS_IGNORE_DISTANCE = 3.0
GUESS_IGNORE_MIN_POSITIVE = 2.0
GUESS_RELATIVE_IGNORE_DISTANCE = 0.3
ITERATION_MIN_IMPROVEMENT = 0.5
MAX_ITERATIONS = 15
MAX_ITERATIONS_WITHOUT_IMPROVEMENT = 3
MIN_ASSETS_PER_ITERATION = 2
MAX_ASSETS_PER_ITERATION = 8
MIN_ABSOLUTE_SUPPORT = 10.0
MIN_SUPPORT = 0.2
POSITIVE_MATCH_WEIGHT = 1.0
NEGATIVE_MATCH_WEIGHT = 0.1
FAILED_ASSET_WEIGHT = 1.0

# --- page signals -----------------------------------------------------------
ASSET_ELEMENTS = ("link", "script", "style")
SUPPORTED_SCHEMES = ("http", "https")

# --- site ranking -----------------------------------------------------------
MAX_SITE_RANK = 1_000_000

# --- archived resources -----------------------------------------------------
ARCHIVE_NAME_LIMIT = 200
ARCHIVE_NAME_KEEP = 50

# --- file types: name, extensions, used for analysis, used for index, checksum basis
# Two more types have no extension list: "dotfile" (leading dot) and
# "extensionless" (no dot at all, not used for analysis).
FILE_TYPES = (
    ("config", ("conf", "dist", "ini"), True, True, "raw"),
    ("css", ("css", "less", "scss"), True, True, "raw"),
    ("font", ("ttf",), True, True, "raw"),
    ("gettext", ("mo", "po"), True, True, "raw"),
    ("html", ("htm", "html", "xhtml"), False, True, "raw"),
    ("image", ("gif", "ico", "jpeg", "jpg", "png", "svg"), True, True, "raw"),
    ("javascript", ("js",), True, True, "raw"),
    ("json", ("json",), True, True, "canonical"),
    ("media", ("swf", "xap"), True, True, "raw"),
    ("text", ("markdown", "md", "rst", "txt"), True, True, "raw"),
    ("xml", ("xml",), True, True, "raw"),
    ("yaml", ("yaml", "yml"), True, True, "canonical"),
)

# --- software definitions ---------------------------------------------------
# name, vendor, alternative names, source kind, version pattern, path map (webroot, src)
DEFINITIONS = (
    ("Contao Open Source CMS", "Contao Community", ("Contao",), "tags", None, (("/", "/"),)),
    ("DokuWiki", "Andreas Gohr, et al.", (), "tags",
     r"^release_stable_(?P<version_name>[0-9a-z-]+)$", (("/", "/"),)),
    ("Drupal", "Drupal", (), "tags", r"\d\..*", (("/", "/"),)),
    ("Etherpad Lite", "Ether", ("Etherpad",), "tags", None, (("/static/", "/src/static/"),)),
    ("Gitlab Enterprise Edition", "Gitlab Inc.", (), "deb:gitlab-ee", None,
     (("/", "/opt/gitlab/embedded/service/gitlab-rails/public/"),)),
    ("Gitlab Community Edition", "Gitlab Inc.", (), "deb:gitlab-ce", None,
     (("/", "/opt/gitlab/embedded/service/gitlab-rails/public/"),)),
    ("Jitsi Meet", "8x8", (), "deb:jitsi-meet-web", None, (("/", "/usr/share/jitsi-meet/"),)),
    ("Joomla! CMS™", "Open Source Matters", ("Joomla!", "Joomla"), "tags",
     r"^\d+\.\d+\.\d+$", (("/", "/"),)),
    ("Magento Open Source", "Magento Inc.", ("Magento",), "tags",
     r"^\d+\.\d+\.\d+$", (("/", "/"),)),
    ("MediaWiki", "Wikimedia Foundation", (), "tags",
     r"^(?P<version_name>(\d+)\.(\d+)\.(\d+))$", (("/", "/"),)),
    ("Moodle", "Moodle HQ", (), "tags", r"^v(?P<version_name>\d+\.\d+\.\d+)$", (("/", "/"),)),
    ("Nextcloud", "NextCloud GmbH", (), "tags",
     r"^v(?P<version_name>(\d+)\.(\d+)\.(\d+))$", (("/", "/"),)),
    ("OpenCart", "OpenCart Limited", (), "tags", None, (("/", "/upload/"),)),
    ("ownCloud", "ownCloud", (), "tags",
     r"^v(?P<version_name>(\d+)\.(\d+)\.(\d+))$", (("/", "/"),)),
    ("phpBB", "phpBB Limited", (), "tags",
     r"^release-(?P<version_name>\d+(\.\d+)?(\.\d+)?)$", (("/", "/phpBB"),)),
    ("PrestaShop", "PrestaShop", (), "tags", None, (("/", "/"),)),
    ("SOGo", "Inverse Inc", (), "tags", None, (("/SOGo/SOGo.woa/", "/UI/"),)),
    ("TYPO3", "TYPO3 GmbH", (), "tags", r"^TYPO3_(?P<version_name>\d+-\d+-\d+)$", (("/", "/"),)),
    ("WordPress", "WordPress", (), "tags", None, (("/", "/"),)),
)

# Packages whose version name is derived from the whole tag: 6-2-1 -> 6.2.1
DASHED_TAG_PACKAGES = ("TYPO3",)

# --- patterns of names -------------------------------------------------------
DASHED_TAG, DOTTED_TAG = r"(\d+)-(\d+)-(\d+)(.*)", "$1.$2.$3-$4"
VERSION_GROUP = "version_name"
RULE_VERSION = r"\\;version:.*$"
NOT_IN_PATH_NAMES = r"[^A-Za-z0-9\-_.()=\[\]{}\\]"
