"""Thresholds, command codes, word lists and report texts."""

# Thresholds.
LARGE_UPLOAD_BYTES = 5 * 1024 * 1024
LONG_QNAME_CHARS = 50
FLOW_THRESHOLD_MB = 5
UNCERTAINTY_MARGIN = 0.15
SSDEEP_MIN_SCORE = 90
TLSH_MAX_DISTANCE = 50
TFTP_BLOCK_BYTES = 512
TARGET_ENCODING_SMOOTHING = 20.0
SYNTHETIC_ROWS = {"train": 40_000, "val": 10_000, "test": 10_000}
REPORT_TOP_DESTINATIONS = 50
SUMMARY_TOP_DESTINATIONS = 10
SUMMARY_FINDINGS = 20

# Finding notes.
NOTE_HTTP_LARGE = "Large HTTP request body"
NOTE_HTTP_MULTIPART = "Saved file from multipart/form-data in HTTP request"
NOTE_HTTP_PEELED = "Saved file after peeling multipart from HTTP request"
NOTE_HTTP_RESPONSE = "Saved file from HTTP response Content-Disposition"
NOTE_HTTP_DISPOSITION = "Filename seen in Content-Disposition header (no body saved)"
NOTE_FTP_STOR = "FTP file upload (STOR) from host"
NOTE_FTP_SEEN = "FTP transfer filename observed"
NOTE_TFTP_WRQ = "TFTP file upload (WRQ) from host"
NOTE_TFTP_REBUILT = "TFTP transfer reconstructed"
NOTE_TFTP_PARTIAL = "Incomplete TFTP transfer (saved partial data)"
NOTE_SMB_LARGE = "; Large write"
NOTE_SMTP_ATTACHMENT = "Saved attachment extracted from SMTP message"
NOTE_SMTP_LARGE = "Large SMTP message body from host"
NOTE_DNS_LONG = "Long DNS query name (simple heuristic)"
NOTE_DNS_MODEL = "ML-based DNS exfiltration detection (no packet details)"
NOTE_FLOW = "Host sent a large total of outbound data: "

# SMB command codes that create or write.
SMB_NT_CREATE_ANDX = "0xa2"
SMB_WRITE_ANDX = "0x2f"
SMB_READ_ANDX = "0x2e"
SMB2_CREATE = "5"
SMB2_READ = "8"
SMB2_WRITE = "9"

# DNS resource record types with a frequency column of their own.
RR_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 13: "HINFO",
    15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT",
}

# Model feature groups.
STATELESS_NUMERIC = [
    "FQDN_count", "subdomain_length", "upper", "lower", "numeric", "entropy",
    "special", "labels", "labels_max", "labels_average", "len", "subdomain",
]
STATELESS_CATEGORICAL = ["longest_word", "sld"]
STATEFUL_NUMERIC = (
    ["rr"] + [f"{name}_frequency" for name in RR_TYPES.values()]
    + ["rr_count", "rr_name_entropy", "rr_name_length", "distinct_ns", "a_records",
       "ttl_mean", "ttl_variance"]
)
STATEFUL_CATEGORICAL = [
    "rr_type", "distinct_ip", "unique_country", "unique_asn", "distinct_domains",
    "reverse_dns", "unique_ttl",
]

# File signatures, first match wins, and the names of NTFS metadata files.
SIGNATURES = [
    ("25504446", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("504B0304", "application/zip"),
    ("4D5A", "application/x-dosexec"),
]
NTFS_META_NAMES = ["$MFT", "$I30", "$SDS", "$Secure", "$Extend", "$ObjId"]
TYPE_EMPTY = "inode/x-empty"
TYPE_UNKNOWN = "application/octet-stream"
TYPE_NTFS_META = "filesystem/ntfs-meta"
TYPE_EXECUTABLE = "application/x-dosexec"

# Path endings that mark USB-bearing files, compared in lower case.
WINDOWS_HIVE_SUFFIXES = [
    "/windows/system32/config/system",
    "/windows/system32/config/system (deleted)",
]
LINUX_LOG_SUFFIXES = ["/var/log/syslog", "/var/log/messages", "/var/log/kern.log"]

# Regular expressions (Java syntax).
RE_BOUNDARY_HTTP = r"(?i)boundary=([^\n]+)"
RE_BOUNDARY_MIME = r'(?i)boundary="?([^";\r\n]+)"?'
RE_FILENAME = r'''(?i)filename\*?=(?:UTF-8'')?"?([^";\r\n]+)"?'''
RE_NAME_PARAM = r'name="?([^";\r\n]+)"?'
RE_DISPOSITION = r"(?i)Content-Disposition:\s*[^\n]*filename"
RE_DASH_BOUNDARY = r"------[^\r\n]+"
RE_TFTP_FILE = r"File:\s*([^\s,]+)"
RE_USB_EVENT = r"(?i)usb\s+\d+-\d+:"
RE_USB_PAIR = r"(?i)(idVendor|idProduct|Manufacturer|Product|SerialNumber)=(\S+)"
RE_SYSLOG_STAMP = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
RE_REPORT_SHA256 = r"sha256=([a-fA-F0-9]{64})"
RE_REPORT_SIZE = r"(\d+)\s+bytes"
RE_REPORT_TYPE = r"type=([\w\d\-_.]+)"
