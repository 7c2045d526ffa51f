"""What imported functions do: (name, tag), names in lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names by capability, in alphabetical order.
NAMES = {
    "calls_alloc": (
        "calloc", "free", "globalalloc", "globalfree", "globalrealloc", "heapalloc", "heapcreate", "heapdestroy",
        "heapfree", "heaprealloc", "localalloc", "localfree", "localrealloc", "malloc", "realloc", "rtlallocateheap",
        "rtlfreeheap", "rtlreallocateheap", "virtualalloc", "virtualallocex", "virtualfree", "virtualfreeex",
    ),
    "calls_memcpy": (
        "lstrcpya", "lstrcpyna", "lstrcpyw", "memcmp", "memcpy", "memmove", "memset", "rtlcomparememory",
        "rtlcopymemory", "rtlfillmemory", "rtlmovememory", "rtlzeromemory", "strcpy", "strcpy_s", "strncpy",
        "strncpy_s",
    ),
    "calls_network": (
        "accept", "bind", "closesocket", "connect", "freeaddrinfo", "getaddrinfo", "gethostbyname", "gethostname",
        "httpopenrequesta", "httpopenrequestw", "httpsendrequesta", "httpsendrequestw", "internetclosehandle",
        "internetconnecta", "internetconnectw", "internetopena", "internetopenurla", "internetopenurlw",
        "internetopenw", "internetreadfile", "internetwritefile", "listen", "recv", "recvfrom", "send", "sendto",
        "shutdown", "socket", "winhttpconnect", "winhttpopen", "winhttpopenrequest", "winhttpsendrequest",
        "wsacleanup", "wsagetlasterror", "wsastartup",
    ),
    "calls_filesystem": (
        "close", "copyfilea", "copyfilew", "createdirectorya", "createdirectoryw", "createfilea", "createfilew",
        "deletefilea", "deletefilew", "fclose", "findclose", "findfirstfilea", "findfirstfilew", "findnextfilea",
        "findnextfilew", "fopen", "fopen_s", "fread", "fstat", "fwrite", "getfileattributesa", "getfileattributesw",
        "getfilesize", "getfilesizeex", "getfiletype", "lstat", "movefilea", "movefileexa", "movefileexw",
        "movefilew", "open", "openfile", "read", "readfile", "readfileex", "removedirectorya", "removedirectoryw",
        "rename", "setfileattributesa", "setfileattributesw", "setfilepointer", "setfilepointerex", "stat", "unlink",
        "write", "writefile", "writefileex",
    ),
    "calls_registry": (
        "regclosekey", "regcreatekeya", "regcreatekeyexa", "regcreatekeyexw", "regcreatekeyw", "regdeletekeya",
        "regdeletekeyexa", "regdeletekeyexw", "regdeletekeyw", "regdeletevaluea", "regdeletevaluew", "regenumkeya",
        "regenumkeyexa", "regenumkeyexw", "regenumkeyw", "regenumvaluea", "regenumvaluew", "regopenkeya",
        "regopenkeyexa", "regopenkeyexw", "regopenkeyw", "regqueryvaluea", "regqueryvalueexa", "regqueryvalueexw",
        "regqueryvaluew", "regsetvaluea", "regsetvalueexa", "regsetvalueexw", "regsetvaluew",
    ),
    "calls_process": (
        "createprocessa", "createprocessasusera", "createprocessasuserw", "createprocessw", "createremotethread",
        "createremotethreadex", "createthread", "exitprocess", "getthreadcontext", "ntcreatethreadex",
        "ntqueueapcthread", "openprocess", "openthread", "queueuserapc", "readprocessmemory", "resumethread",
        "rtlcreateuserthread", "setthreadcontext", "suspendthread", "terminateprocess", "terminatethread",
        "virtualprotectex", "writeprocessmemory",
    ),
    "calls_crypto": (
        "bcryptclosealgorithmprovider", "bcryptcreatehash", "bcryptdecrypt", "bcryptencrypt", "bcryptgenrandom",
        "bcrypthashdata", "bcryptopenalgorithmprovider", "cryptacquirecontexta", "cryptacquirecontextw",
        "cryptcreatehash", "cryptdecrypt", "cryptderivekey", "cryptdestroyhash", "cryptdestroykey", "cryptencrypt",
        "cryptexportkey", "cryptgenrandom", "crypthashdata", "cryptimportkey", "cryptreleasecontext", "ncryptopenkey",
        "ncryptopenstorageprovider",
    ),
    "calls_loader": (
        "dlclose", "dlopen", "dlsym", "freelibrary", "getmodulehandlea", "getmodulehandleexa", "getmodulehandleexw",
        "getmodulehandlew", "getprocaddress", "ldrgetprocedureaddress", "ldrloaddll", "loadlibrarya",
        "loadlibraryexa", "loadlibraryexw", "loadlibraryw",
    ),
    "calls_debug": (
        "addvectoredexceptionhandler", "checkremotedebuggerpresent", "continuedebugevent", "debugactiveprocess",
        "debugbreak", "isdebuggerpresent", "ntqueryinformationprocess", "outputdebugstringa", "outputdebugstringw",
        "removevectoredexceptionhandler", "setunhandledexceptionfilter", "unhandledexceptionfilter",
        "waitfordebugevent",
    ),
}


def rows() -> list[tuple[str, str]]:
    """(name, tag) of all names; each has one capability."""
    return [(name, tag) for tag, names in NAMES.items() for name in names]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "name string, tag string")
