"""Fixed schemas of the record types, as Spark DDL."""

# Field names, enumerations and version of a run report.
COUNTS = (
    "struct<scannedFiles:bigint,selectedFiles:bigint,uploadedFiles:bigint,"
    "downloadedFiles:bigint,failedFiles:bigint,verifiedFiles:bigint,"
    "verifyFailedFiles:bigint,deletedRemoteFiles:bigint,retriedOperations:bigint>"
)
RUN_REPORT = (
    "schemaVersion string, runId string, mode string, status string, "
    "startedAt timestamp, finishedAt timestamp, durationMs bigint, "
    "command struct<argv:array<string>,version:string>, "
    "paths struct<source:string,target:string,pathFilter:string,patternFilter:string>, "
    f"counts {COUNTS}, exitCode int, failureCode string, "
    "warnings array<string>, failedPaths array<string>, "
    "artifacts struct<manifestPath:string,logPath:string,reportPath:string,restoreDiffPath:string>"
)
REPORT_VERSION = "1.0.0"
REPORT_MODES = ("backup", "restore")
REPORT_STATUSES = ("success", "partial", "failure", "dry-run")
REPORT_COUNTS = [
    "scannedFiles",
    "selectedFiles",
    "uploadedFiles",
    "downloadedFiles",
    "failedFiles",
    "verifiedFiles",
    "verifyFailedFiles",
    "deletedRemoteFiles",
]
REPORT_KEYS = {
    "root": [
        "schemaVersion", "runId", "mode", "status", "startedAt", "finishedAt",
        "durationMs", "command", "paths", "counts", "exitCode", "failureCode",
        "warnings", "failedPaths", "artifacts",
    ],
    "command": ["argv", "version"],
    "paths": ["source", "target", "pathFilter", "patternFilter"],
    "counts": [*REPORT_COUNTS, "retriedOperations"],
    "artifacts": ["manifestPath", "logPath", "reportPath", "restoreDiffPath"],
}
LEDGER = "test string, verdict string, message string, detail string"
QUOTA = "total bigint, used bigint, free bigint"
