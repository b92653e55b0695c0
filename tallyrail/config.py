"""Channel rules and the fixed values the reports are defined by."""

from __future__ import annotations

from dataclasses import dataclass

# Response codes.
APPROVED = "00"
NO_RESPONSE = "93"
CUSTOMER_CODES = ("14", "34", "51", "52", "53", "55", "61", "62", "75", "76", "77", "88", "N7", "93")

# Network-management messages left out of the volume series.
ADMIN_KEY = ("NEW_KEY",)
ADMIN_ATM = ("NEW_KEY", "NGTLNAP")
ADMIN_NETWORK = ("LOG__ON", "LOG_OFF", "NEW_KEY", "ECHOMSG", "CUTOVER")
ADMIN_CARD = ("LG2_VON", "LOG_VON", "LOGVOFF", "NEW_KEY", "INITKEY", "LG2VOFF")
ADMIN_OUTBOUND = ("#LOG_ON", "#LOGOFF", "#CHGKEY", "#CUTOFF")
NON_FINANCIAL = ("DUKCALL", "PDFMAIL")

# Business codes.
ODS = "ODS"
OUTBOUND_BSNS = "EB1"


@dataclass(frozen=True)
class ChannelRule:
    """Which rows of one channel a report counts."""

    switch_id: str
    only_trx: tuple[str, ...] = ()
    exclude_trx: tuple[str, ...] = ()
    exclude_bsns: tuple[str, ...] = ()


def rules(*switch_ids: str, **limits: tuple[str, ...]) -> tuple[ChannelRule, ...]:
    return tuple(ChannelRule(s, **limits) for s in switch_ids)


# The channels of each report.
SUMMARY_INBOUND = (
    ChannelRule("ATMD", exclude_trx=("NGTLNAP",)),
    ChannelRule("GIBI", exclude_bsns=(ODS,)),
    *rules("LOCL", "VADP", "SMSD", "ARON", "BRSM", "RNTS"),
)
SUMMARY_OUTBOUND = (
    *rules("RNTS", "DIMO", "FINN", "TIPH", "EURO", "IONX", "BIIH"),
    ChannelRule("SWDK", exclude_trx=NON_FINANCIAL),
)
LEG_MIX_INBOUND = (
    ChannelRule("ATMD", exclude_trx=("NGTLNAP",)),
    *rules("GIBI", "LOCL", "RNTS", "BRSM", "VADP", "ARON", "SMSD"),
)
LEG_MIX_OUTBOUND = (
    *rules("RNTS", "FINN", "EURO", "IONX", "BIIH", "TIPH"),
    ChannelRule("SWDK", only_trx=("HNCNINQ", "HNCNPAY")),
)
ACTIVE_INBOUND = (
    ChannelRule("ATMD"),
    ChannelRule("GIBI", exclude_bsns=(ODS,)),
    *rules("LOCL", "VADP", "SMSD", "ARON", "BRSM", "RNTS"),
)
ACTIVE_OUTBOUND = rules("RNTS", "FINN", "TIPH", "EURO", "IONX", "BIIH", "SWDK")
HEALTH_INBOUND = rules(
    "VADP", "LNBI", "RNTS", "LOCL", "GIBI", "BRSM", "ATMD", "ARON",
    exclude_trx=ADMIN_ATM, exclude_bsns=(ODS,))
HEALTH_OUTBOUND = (
    *rules("TIPH", "IONX", "FINN", "EURO", "RNTS", "QRIS", "BIIH"),
    ChannelRule("SWDK", exclude_trx=NON_FINANCIAL),
)
HEALTH_EXCLUDED_RESPONSES = ("EF",)

# Bill payment.
BILLPAY_CHANNELS = ("VADP", "SMSD", "LOCL", "GIBI", "ATMD")
BILLPAY_PAYMENTS = ("0520A01", "NBLLPOS", "NBLLPAY")
BILLPAY_INQUIRIES = ("0420A01", "NBLLINQ", "NBLLCHK")
BILLPAY_CATALOG = "PART_CENT_ID"
MESSAGE_CATALOG = "INTER_ID"

# Message catalog report.
SPLIT_CHANNELS = ("GIBI",)
OUTBOUND_FEEDS = {"GIBI": ("RNTS", "BRSM")}
OUTBOUND_FEED_PREFIX = "0"
REQUEST_CODED = {"ATMD": ("NWDLCRL",)}
INACTIVE_PREFIX = "X"
CATALOG_EXTRAS = (
    {"cnts_nm": "INTER_ID", "cnts_1": "NBLLPOS", "cnts_2": "XX", "cnts_3": "XX", "cnts_4": "Inward",
     "cnts_5": "GIBI"},
    {"cnts_nm": "INTER_ID", "cnts_1": "NBLLPAY", "cnts_2": "XX", "cnts_3": "XX", "cnts_4": "Inward",
     "cnts_5": "GIBI"},
)

# Payload positions (1-based) and lengths.
TERMINAL_FIELD = (15, 8)
PRODUCT_FIELD = (86, 5)
OUTBOUND_BSNS_FIELD = (312, 3)
COUNTRY_FIELD = (711, 2)
LAYOUT_BASE = 301

# Terminal transaction families by message prefix.
TERMINAL_FAMILIES = {
    "NWDL": "WDL", "XWDL": "WDL",
    "NTRH": "TRF", "NTRO": "TRF", "XTRH": "TRF", "XTRO": "TRF", "NTIO": "TRF", "NTIH": "TRF",
}

# Card report.
CARD_PREFIX = "DEBIT"
HOME_COUNTRY = "ID"

# Report order of the channels.
CHANNEL_RANKS = (
    ("GIBI", "MBK", 1),
    ("GIBI", "PBK", 2),
    ("GIBI", "CBS", 3),
    ("SMSD", "EB1", 4),
    ("ATMD", "EB1", 5),
    ("LOCL", "EB1", 6),
    ("VADP", "EB1", 7),
    ("RNTS", "EB1", 8),
    ("BRSM", "EB1", 9),
    ("TIPH", "EB1", 10),
    ("IONX", "EB1", 12),
    ("FINN", "EB1", 13),
    ("EURO", "EB1", 14),
    ("BIIH", "EB1", 15),
    ("ARON", "EB1", 16),
    ("SWDK", "EB1", 17),
    ("DIMO", "EB1", 18),
)
LAST_RANK = 19

# Display names; a NULL business code stands for every business code of the channel.
CHANNEL_LABELS = (
    ("ATMD", None, "ATM Driving"),
    ("GIBI", "PBK", "Personal Banking(PBK)"),
    ("GIBI", "MBK", "Mobile Banking(MBK)"),
    ("GIBI", "ODS", "1Q Pioneer"),
    ("GIBI", "CBS", "Corporate Banking(CBS)"),
    ("LOCL", None, "EDC"),
    ("ARON", None, "Visa"),
    ("VADP", None, "Phone Banking"),
    ("SMSD", None, "SMS Banking"),
    ("BRSM", None, "ATM Bersama"),
    ("RNTS", None, "Jaringan PRIMA"),
    ("EURO", None, "Euronet"),
    ("FINN", None, "Finnet"),
    ("BIIH", None, "Maybank"),
    ("TIPH", None, "Tiphone"),
    ("SHFX", None, "SinarmasHF"),
    ("IONX", None, "Nicepay"),
    ("DIMO", None, "Dimo"),
    ("SWDK", None, "Bimasakti"),
)
OTHER_LABEL = "Other"
SEGMENT_LABELS = (
    ("VISA LOCAL", None, "VISA Local"),
    ("VISA OVERSEAS", None, "VISA Overseas"),
    ("BRSM", None, "NPG Bersama"),
    ("RNTS", None, "NPG Prima"),
)

# Message code -> common header layout.
MESSAGE_FAMILIES = {
    **dict.fromkeys((
        "DEBTVMC", "DEBTVMS", "DEBTVMT", "GETVCRD", "LOG_VON", "LOGVOFF", "LG2_VON", "LG2VOFF",
        "DBCSHVF", "DBCSHVS", "DBCSHPN", "DEBITPN", "GETVCCT", "CREDTPN", "GTPNBAL", "GTPMBAL",
        "CVOIDPN", "ONLINPN", "BOOK_PN", "GTVFBAL", "INCVPIN", "CREDTVF", "CREDTVS", "GETBINQ",
        "GETBPAY"), "EIOVCOM"),
    "REVMSAL": "EIOZCOM",
}
DEFAULT_FAMILY = "EIO_COM"

# Names that mark the currency and the amount field of a layout.
CURRENCY_NAMES = ("CCY_CD", "CURRENCY")
AMOUNT_NAMES = ("TRX_AMT", "TRANSACTION_AMOUNT")

# Authentication outcome labels.
AUTH_LABELS = {"05": "Success 3DS", "06": "Trying 3DS", "07": "Failed 3DS"}
AUTH_MISSING = "OFFLINE"

# Code types of the city and the province lists.
CITY_TYPE = "F787"
PROVINCE_TYPE = "F795"

# Province name -> map key.
PROVINCE_KEYS = {
    "DI LUAR INDONESIA": "id-3700",
    "NANGGROE ACEH DARUSSALAM": "id-ac",
    "JAWA TENGAH": "id-jt",
    "BENGKULU": "id-be",
    "BANTEN": "id-bt",
    "KALIMANTAN BARAT": "id-kb",
    "KEP. BANGKA BELITUNG": "id-bb",
    "BALI": "id-ba",
    "JAWA TIMUR": "id-ji",
    "KALIMANTAN SELATAN": "id-ks",
    "NUSA TENGGARA TIMUR": "id-nt",
    "SULAWESI SELATAN": "id-se",
    "KEP. RIAU": "id-kr",
    "IRIAN JAYA BARAT": "id-ib",
    "SUMATERA UTARA": "id-su",
    "RIAU": "id-ri",
    "SULAWESI UTARA": "id-sw",
    "KALIMANTAN UTARA": "id-ku",
    "MALUKU UTARA": "id-la",
    "SUMATERA BARAT": "id-sb",
    "MALUKU": "id-ma",
    "NUSA TENGGARA BARAT": "id-nb",
    "SULAWESI TENGGARA": "id-sg",
    "SULAWESI TENGAH": "id-st",
    "PAPUA": "id-pa",
    "JAWA BARAT": "id-jr",
    "KALIMANTAN TIMUR": "id-ki",
    "LAMPUNG": "id-1024",
    "DKI JAKARTA": "id-jk",
    "GORONTALO": "id-go",
    "D.I YOGYAKARTA": "id-yo",
    "SUMATERA SELATAN": "id-sl",
    "SULAWESI BARAT": "id-sr",
    "JAMBI": "id-ja",
    "KALIMANTAN TENGAH": "id-kt",
}
LOCATION_OVERRIDES = {"Depok": "DEPOK"}

# Alert hours (text compare against the slot label) and thresholds.
FEED_HOURS = ("07:45:00", "15:00:00")
SLOT_HOURS = ("08:30:00", "20:00:00")
ALERT_SLOT = 10
FAILURE_LIMIT = 50
