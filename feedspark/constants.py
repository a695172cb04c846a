"""Protocol constants.

FIXED VALUES -- these must equal the original feed protocol for results to
match; they are stated here once, in natural order, and used everywhere else
by name.
"""

# ---- fixed values (protocol) -------------------------------------------------
MAX_PACKET_BYTES = 5000          # packets of this size or more are counted as oversize
SECRET_LEN = 10                  # authentication secret in front of every packet
BODY_OFFSET = 11                 # secret plus one unchecked separator byte
FIELD_SEP = "^"                  # field separator inside a packet / reply
REPLY_HEADER = "Missed Packets:" # first 15 characters of a good recovery reply
REPLY_SKIP = 16                  # header plus one separator character
BATCH_SIZE = 10                  # sequence numbers per recovery request
FRAME_SIZE = 1024                # bytes per delivery frame
REFRESH_FALLBACK_S = 30          # refresh seconds when the server value is unusable
REFRESH_AFTER_BAD_S = 2          # refresh seconds after a malformed reply
INT_MAX = 2147483647
INT_MIN = -2147483648
SCAN_PERIOD = "2 seconds"        # loss scan trigger
RECOVERY_PERIOD = "10 seconds"   # recovery trigger
AUDIT_TIME_FORMAT = "dd/MM/yy->hh:mm:ss"
KEY_CHARS_PATTERN = "^[A-Za-z0-9-]*$"
# ------------------------------------------------------------------------------

# Tuning knobs (not protocol): width of a numbering bucket.  Windows never run
# over a whole (channel, feed_date); they run over (channel, feed_date, bucket)
# so one hot date spreads over many tasks.
SEQ_BUCKET = 1 << 17
# Largest gap exploded inline; wider gaps are cut into chunks of this size and
# spread over tasks before expansion.
EXPAND_CHUNK = 1 << 16
