"""Schemas of the resource kinds and registry tables. Nothing is inferred at read time."""

from __future__ import annotations

CONDITION = (
    "struct<type:string,status:string,reason:string,message:string,"
    "lastTransitionTime:timestamp,observedGeneration:bigint>"
)

# The fields each resource kind keeps under spec.forProvider.
SPEC_FIELDS = {
    "Device": "uuid:string,code:string,status:string,name:string,type:string,agent:string,wstun_ip:string,"
              "session:string,lr_version:string,location:array<struct<longitude:string,latitude:string,"
              "altitude:string,updated_at:array<string>>>,services:array<string>,plugins:array<string>",
    "Site": "uuid:string,name:string,description:string,location:string,parentSite:string,config:map<string,string>",
    "Fleet": "uuid:string,name:string,description:string,project:string,extra:string",
    "Plugin": "uuid:string,name:string,code:string,version:string,parameters:string",
    "Service": "uuid:string,name:string,project:string,protocol:string,port:int",
    "Webservice": "uuid:string,name:string,boardUuid:string,port:int,secure:boolean,extra:string",
    "Port": "uuid:string,boardUuid:string,macAdd:string,vifName:string,network:string,ip:string",
    "Request": "uuid:string,destinationUuid:string,mainRequestUuid:string,status:string,project:string,"
               "action:string,pendingRequests:int,type:int",
    "Result": "uuid:string,boardUuid:string,requestUuid:string,result:string,message:string",
    "BoardPluginInjection": "boardUuid:string,pluginUuid:string",
    "BoardServiceInjection": "boardUuid:string,serviceUuid:string",
}

# The spec of kinds that keep their fields right under spec.
PLAIN_SPEC_FIELDS = {
    "Project": "projectName:string,owner:string",
    "ProviderConfig": "domain:string,credentials:struct<source:string>",
    "Pod": "nodeName:string,serviceAccountName:string,containers:array<struct<name:string,image:string>>",
    "Namespace": "finalizers:array<string>",
    "Node": "podCIDR:string,unschedulable:boolean",
    "v1/Service": "type:string,clusterIP:string,selector:map<string,string>,"
                  "ports:array<struct<name:string,port:int,nodePort:int,protocol:string>>",
}

# Kinds that keep their fields at the top of the document.
TOP_FIELDS = {
    "ClusterRole": "rules:array<struct<apiGroups:array<string>,resources:array<string>,verbs:array<string>>>",
    "Role": "rules:array<struct<apiGroups:array<string>,resources:array<string>,verbs:array<string>>>",
    "RoleBinding": "roleRef:struct<kind:string,name:string>,subjects:array<struct<kind:string,name:string,namespace:string>>",
    "ClusterRoleBinding": "roleRef:struct<kind:string,name:string>,subjects:array<struct<kind:string,name:string,namespace:string>>",
    "ProviderConfigUsage": "providerConfigRef:struct<name:string>,resourceRef:struct<apiVersion:string,kind:string,name:string>",
}

# What a kind reports beside its conditions; under status.atProvider unless the kind's spec is plain.
STATUS_FIELDS = {
    "Site": "uuid:string,name:string,code:string,status:string,deviceCount:int",
    "Project": "namespaceReady:boolean,rbacReady:boolean,s4tReady:boolean",
    "ProviderConfig": "users:bigint",
    "Pod": "phase:string,podIP:string,containerStatuses:array<struct<name:string,ready:boolean,restartCount:int>>",
    "Namespace": "phase:string",
    "Node": "nodeInfo:struct<kubeletVersion:string>",
    "v1/Service": "loadBalancer:struct<ingress:array<struct<ip:string>>>",
}
OBSERVED = "uuid:string,code:string,status:string"

# The columns of the registry tables.
REGISTRY = {
    "boards": "uuid string, code string, name string, status string, agent string",
    "plugins": "uuid string, name string, code string, version string, parameters string",
    "services": "uuid string, name string, project string, protocol string, port int",
    "webservices": "uuid string, name string, board_uuid string, port int, secure boolean, extra string",
    "ports_on_boards": "uuid string, board_uuid string, mac_add string, vif_name string, network string, ip string",
    "injection_plugins": "board_uuid string, plugin_uuid string, status string, onboot boolean",
    "wampagents": "hostname string, ragent int, online int, created_at timestamp",
    "sessions": "board_uuid string, valid int",
}

TELEMETRY = (
    "timestamp double, temperature double, humidity double, pressure double, wind_speed double, wind_direction int"
)


def resource_schema(kind: str) -> str:
    """One resource document: metadata, wanted fields, observed fields and conditions."""
    head = (
        "struct<apiVersion:string,kind:string,metadata:struct<name:string,namespace:string,generation:bigint,"
        "creationTimestamp:timestamp,labels:map<string,string>,annotations:map<string,string>>,"
    )
    observed = STATUS_FIELDS.get(kind, OBSERVED)
    if kind in TOP_FIELDS:
        return f"{head}{TOP_FIELDS[kind]}>"
    if kind in PLAIN_SPEC_FIELDS:
        return f"{head}spec:struct<{PLAIN_SPEC_FIELDS[kind]}>,status:struct<{observed},conditions:array<{CONDITION}>>>"
    return (
        f"{head}spec:struct<forProvider:struct<{SPEC_FIELDS[kind]}>,deletionPolicy:string>,"
        f"status:struct<atProvider:struct<{observed}>,conditions:array<{CONDITION}>>>"
    )
