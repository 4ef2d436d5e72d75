"""Names and code sets of the JPEG format. All values here are fixed values."""

from __future__ import annotations

# Marker codes.
SOI, EOI, SOS, DQT, DHT, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE
RST0, RST7 = 0xD0, 0xD7


def is_sof(code: str) -> str:
    """SQL: the code of a frame header (C0-CF without DHT, JPG and DAC)."""
    return f"({code} BETWEEN 192 AND 207 AND {code} NOT IN (196, 200, 204))"


def is_rst(code: str) -> str:
    return f"({code} BETWEEN 208 AND 215)"


def is_standalone(code: str) -> str:
    return f"({code} = 1 OR {code} BETWEEN 208 AND 215)"


def may_follow_scan(code: str) -> str:
    """SQL: markers an encoder can write after a scan."""
    return (
        f"(({code} BETWEEN 192 AND 207 AND {code} <> 200) OR {code} BETWEEN 224 AND 239 "
        f"OR {code} BETWEEN 217 AND 223 OR {code} = 254)"
    )


def marker_name(code: str) -> str:
    """SQL: display name of a marker code (fixed values)."""
    return f"""CASE
        WHEN {code} = 216 THEN 'SOI' WHEN {code} = 217 THEN 'EOI' WHEN {code} = 218 THEN 'SOS'
        WHEN {code} = 219 THEN 'DQT' WHEN {code} = 196 THEN 'DHT' WHEN {code} = 221 THEN 'DRI'
        WHEN {code} = 254 THEN 'COM'
        WHEN {code} = 192 THEN 'SOF0 (baseline)' WHEN {code} = 193 THEN 'SOF1 (extended)'
        WHEN {code} = 194 THEN 'SOF2 (progressive)'
        WHEN {code} BETWEEN 224 AND 239 THEN concat('APP', cast({code} - 224 AS string))
        WHEN {code} BETWEEN 208 AND 215 THEN concat('RST', cast({code} - 208 AS string))
        WHEN {code} BETWEEN 192 AND 207 THEN concat('SOF', cast({code} - 192 AS string))
        ELSE concat('FF', lpad(hex({code}), 2, '0')) END"""


# Anomaly bits of an MCU record, lowest bit first.
ANOMALY_BITS = [
    (1, "invalid Huffman code"),
    (2, "coefficients past the end of the block"),
    (4, "marker inside the MCU"),
    (8, "restart marker out of order"),
    (16, "restart marker missing"),
    (32, "data ran out"),
    (64, "value out of range"),
]
TRUNCATED = 32

# The GUID at the end of a STOP/Djvu footer.
RANSOM_GUID = "{36A698B9-D67C-4E07-BE82-0EC5B14B4DF5}"

# Verdict names.
VERDICTS = {
    "healthy": "healthy",
    "trailer": "healthy, data after image",
    "ransomware": "ransomware-encrypted header",
    "header": "header damaged",
    "truncated": "truncated",
    "decode": "decode errors",
    "not_jpeg": "not a JPEG",
    "unread": "not read",
}
