"""Channel-name rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Electrode names of the extended 10-20 system used for name matching.
ELECTRODES = [
    "FP1", "FPZ", "FP2",
    "AF9", "AF7", "AF5", "AF3", "AF1", "AFZ", "AF2", "AF4", "AF6", "AF8", "AF10",
    "F9", "F7", "F5", "F3", "F1", "FZ", "F2", "F4", "F6", "F8", "F10",
    "FT9", "FT7", "FC5", "FC3", "FC1", "FCZ", "FC2", "FC4", "FC6", "FT8", "FT10",
    "T9", "T7", "C5", "C3", "C1", "CZ", "C2", "C4", "C6", "T8", "T10",
    "TP9", "TP7", "CP5", "CP3", "CP1", "CPZ", "CP2", "CP4", "CP6", "TP8", "TP10",
    "P9", "P7", "P5", "P3", "P1", "PZ", "P2", "P4", "P6", "P8", "P10",
    "PO9", "PO7", "PO5", "PO3", "PO1", "POZ", "PO2", "PO4", "PO6", "PO8", "PO10",
    "O1", "OZ", "O2", "O9", "CB1", "CB2", "IZ", "O10", "T3", "T5", "T4", "T6", "M1", "M2", "A1", "A2",
    "CFC1", "CFC2", "CFC3", "CFC4", "CFC5", "CFC6", "CFC7", "CFC8", "CCP1", "CCP2", "CCP3", "CCP4", "CCP5", "CCP6", "CCP7", "CCP8", "T1", "T2",
]
# Reference suffixes and type keywords.
REFERENCES = ["A1", "A2", "REF", "GND", "CZ"]
ECG_WORDS = ["ECG", "EKG", "CARDIO", "ELECTROCARDIOGRAM", "HEART"]
EMG_WORDS = ["EMG", "MUSCULAR", "ELECTROMYOGRAM", "MUSCLE"]
EOG_WORDS = ["EOG", "EYE", "OCULAR", "OCULOGRAM", "HEOG", "VEOG"]

_ANY = "(?:" + "|".join(ELECTRODES) + ")"
# electrode followed by a reference, or electrode at the end not preceded by a letter
EEG_JOINED = f"^{_ANY}(?:{'|'.join(REFERENCES)})$|(?:^|[0-9]){_ANY}$"


def tokens(name: Column) -> Column:
    """Upper-cased alphanumeric parts of a channel name."""
    return F.filter(F.transform(F.split(name, "[^a-zA-Z0-9]+"), F.upper), lambda t: t != "")


def channel_type(name: Column, mode: str = "full") -> Column:
    """``ecg`` / ``emg`` / ``eog`` / ``eeg`` / ``misc`` from the channel name.

    The first token decides if it is a type name; then ECG, EMG and EOG keywords in that order; then the
    electrode rules. ``mode="simple"`` keeps only the token rules for EEG.
    """
    toks = tokens(name)
    first = F.try_element_at(toks, F.lit(1))
    upper = F.upper(name)
    listed = F.arrays_overlap(toks, F.array(*[F.lit(e) for e in ELECTRODES]))
    eeg = upper.contains("EEG") | listed
    if mode == "full":
        eeg = eeg | F.array_join(toks, "").rlike(EEG_JOINED)
    elif mode != "simple":
        raise ValueError("mode must be 'full' or 'simple'")
    return (
        F.when(first.isin("ECG", "EMG", "EOG", "EEG"), F.lower(first))
        .when(upper.rlike("|".join(ECG_WORDS)), "ecg")
        .when(upper.rlike("|".join(EMG_WORDS)), "emg")
        .when(upper.rlike("|".join(EOG_WORDS)), "eog")
        .when(eeg, "eeg")
        .otherwise("misc")
    )


def kind_name(kind: Column) -> Column:
    """Channel type of a numeric sensor kind code."""
    return (
        F.when(kind == 2, "EEG").when(kind == 202, "EOG").when(kind == 402, "ECG")
        .when(kind == 302, "EMG").when(kind == 3, "TRIG").otherwise("MISC")
    )


def kind_units(kind: Column) -> Column:
    return F.when(kind_name(kind).isin("EEG", "EOG", "ECG", "EMG"), "microV").otherwise("n/a")


def natural_key(name: Column, width: int = 20) -> Column:
    """Sort key that orders embedded numbers by value: every digit run is left-padded with zeros."""
    marked = F.regexp_replace(name, "([0-9]+)", "\u0001$1\u0001")
    return F.array_join(
        F.transform(
            F.split(marked, "\u0001"),
            lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), width, "0")).otherwise(p),
        ),
        "",
    )
