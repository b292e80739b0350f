"""Label dictionaries per dataset and for captures sorted into folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.logs import lookup

# fixed values (J6): benign applications of the labelled captures -> application class
BENIGN_APPS = {
    "BitTorrent": "P2P", "Facetime": "VoIP", "FTP": "File_Transfer", "Gmail": "Email", "MySQL": "Browsing",
    "Outlook": "Email", "Skype": "VoIP", "SMB": "File_Transfer", "Weibo": "Chat", "WorldOfWarcraft": "Gaming",
}
# fixed values (J6): malware families of the labelled captures -> intent class
MALWARE = {
    "Cridex": "Malware", "Geodo": "Malware", "Htbot": "Botnet", "Miuref": "Malware", "Neris": "Botnet",
    "Nsis-ay": "Malware", "Shifu": "Malware", "Tinba": "Malware", "Virut": "Malware", "Zeus": "Malware",
}
# fixed values (J7): label maps of the merged datasets
DATASET_LABELS = {
    "vnat": {"streaming": "Video_Streaming", "chat": "Chat", "voip": "VoIP", "file_transfer": "File_Transfer",
             "browsing": "Browsing", "c2": "C2_Communication"},
    "iscxvpn2016": {"browsing": "Browsing", "email": "Email", "chat": "Chat", "streaming": "Video_Streaming",
                    "voip": "VoIP", "p2p": "P2P", "file_transfer": "File_Transfer"},
    "cic_ids_2017": {"Benign": "Benign", "Bot": "Botnet", "DDoS": "DDoS", "DoS": "DoS", "PortScan": "Portscan",
                     "Infiltration": "Infiltration", "Web Attack": "Web_Attack"},
}
# fixed values (J7): purpose and VPN flag of the datasets
DATASET_PURPOSE = {"vnat": "app_classification", "iscxvpn2016": "app_classification",
                   "cic_ids_2017": "intent_classification", "ustc_tfc2016": "both", "university_traffic": "test"}
DATASET_VPN = {"vnat": 0, "iscxvpn2016": 1, "cic_ids_2017": 0, "ustc_tfc2016": 0}
CAPTURE_DATASET = "USTC-TFC2016"


def dataset_label(dataset: Column, label: Column, maps: dict[str, dict[str, str]] = DATASET_LABELS) -> Column:
    """Class of a raw label under its dataset's map; unknown labels and
    datasets keep the raw label (J7)."""
    flat = {f"{d}\u0000{k}": v for d, m in maps.items() for k, v in m.items()}
    entries = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, F.concat(dataset, F.lit("\u0000"), label)), label)


def with_dataset_labels(df: DataFrame, dataset_col: str = "dataset", label_col: str = "raw_label") -> DataFrame:
    """Adds label, purpose and vpn_flag of the row's dataset (J7); NULL where
    the dataset has none."""
    d = F.col(dataset_col)
    return df.withColumns({"label": dataset_label(d, F.col(label_col)), "purpose": lookup(d, DATASET_PURPOSE, None),
                           "vpn_flag": lookup(d, DATASET_VPN, None)})


def capture_class_labels(df: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Labels of a capture by its folder or file class (J6, S8): a benign
    application has its application class and intent Benign, a malware family
    app Unknown and its intent; a trailing number of a file does not count;
    other classes have app and intent Unknown."""
    name = F.regexp_replace(F.col(class_col), r"[-_]?[0-9]+$", "")
    benign, malware = lookup(name, BENIGN_APPS, None), lookup(name, MALWARE, None)
    intent = F.when(benign.isNotNull(), F.lit("Benign")).otherwise(F.coalesce(malware, F.lit("Unknown")))
    return df.withColumns({"app_label": F.coalesce(benign, F.lit("Unknown")), "intent_label": intent,
                           "dataset_source": F.lit(CAPTURE_DATASET), "vpn_flag": F.lit(0)})
