"""Keyword rules: a label holds for a text that contains any of its keywords."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = dict[str, list[str]]

# The two rule tables, label by label.
RULES_V1: Rules = {
    "emulator_ci": ["connectedcheck", "emulator", "avdmanager", "adb", "android-emulator-runner"],
    "firebase_test_lab": ["firebase test", "gcloud firebase test android run"],
    "appcenter_test": ["appcenter test run", "microsoft/appcenter-test-cli-action"],
    "browserstack_test": ["browserstack", "browserstack/github-actions"],
}
RULES_V2: Rules = {
    "firebase_test_lab": ["firebase test", "gcloud firebase test android run"],
    "appcenter_test": ["appcenter test run", "microsoft/appcenter-test-cli-action"],
    "browserstack_test": ["browserstack", "browserstack/github-actions"],
    "GitHub_emulator_full": ["android-emulator-runner"],
    "GitHub_emulator_compact": ["malinskiy/action-android/emulator-run-cmd"],
    "GitHub_emulator_manual": ["create avd"],
    "GitHub_gradle": [
        "connectedReleaseAndroidTest",
        "connectedcheck",
        "connectedDebugAndroidTest",
        "connectedAndroidTest",
    ],
}


def effective_keywords(keywords: list[str], fold: bool) -> list[str]:
    """The keywords that can change the answer on a lower-cased text.

    Without folding a keyword that holds a capital never matches, and a keyword that
    contains another one of the same label adds nothing to it.
    """
    words = {k.lower() for k in keywords} if fold else {k for k in keywords if k == k.lower()}
    return sorted(w for w in words if not any(other != w and other in w for other in words))


def label_hits(lowered: Column, rules: Rules, fold: bool = True) -> dict[str, Column]:
    """One boolean column per label over a text that is already lower-cased."""
    return {
        label: reduce(
            or_,
            (F.contains(lowered, F.lit(word)) for word in effective_keywords(words, fold)),
            F.lit(False),
        )
        for label, words in rules.items()
    }


def labels_text(labels: Column, names) -> Column:
    """Render a struct of label flags: sorted names joined by ', ', or 'none'."""
    present = [F.when(labels[name], F.lit(name)) for name in sorted(names)]
    return F.coalesce(F.nullif(F.concat_ws(", ", *present), F.lit("")), F.lit("none"))
