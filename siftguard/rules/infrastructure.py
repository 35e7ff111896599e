"""Detectors for container, compose, Terraform and Kubernetes files (19 rules).

Titles, severities, CWE ids, kinds and patterns are fixed values; the rest is free text.
"""

from __future__ import annotations

from .model import Rule


def _rule(rule_id, kind, severity, cwe, title, pattern, needs, description, fix):
    return Rule(rule_id, "iac", severity, cwe, title, pattern, description, fix,
                kind=kind, needs=needs)


INFRASTRUCTURE_RULES = [
    _rule("DKR1", "dockerfile", "HIGH", "CWE-250", "Container running as root",
          r"(?i)^\s*USER\s+root\s*$", (("user",), ("root",)),
          "Everything in the container runs with full privileges.",
          "Create an unprivileged account in the image and switch to it with USER."),
    _rule("DKR2", "dockerfile", "MEDIUM", "CWE-829", "Using 'latest' tag in base image",
          r"(?i)^\s*FROM\s+\S+:latest\b", (("from",), (":latest",)),
          "The tag moves, so two builds of one commit may differ.",
          "Name an exact version or digest of the base image."),
    _rule("DKR3", "dockerfile", "MEDIUM", "CWE-829", "Using ADD with remote URL",
          r"(?i)^\s*ADD\s+https?://", (("add",), ("http",)),
          "Remote content enters the image without any verification.",
          "Fetch in a RUN step and compare a checksum there."),
    _rule("DKR4", "dockerfile", "HIGH", "CWE-798", "Secret exposed in Dockerfile ENV",
          r"(?i)^\s*ENV\s+\S*(PASSWORD|SECRET|TOKEN|API_KEY|PRIVATE_KEY)\s*=",
          (("env",), ("password", "secret", "token", "api_key", "private_key")),
          "The value is stored in an image layer that anyone with the image can read.",
          "Provide it at run time, or mount it as a build secret."),
    _rule("DKR5", "dockerfile", "MEDIUM", "CWE-200", "Sensitive port exposed in Dockerfile",
          r"^\s*EXPOSE\s+(22|23|3389|5900)\b", (("expose",),),
          "A remote administration port is published by the image.",
          "Drop the port and administer the host through a private network."),
    _rule("DKR6", "dockerfile", "HIGH", "CWE-829", "Piping curl to shell in Dockerfile",
          r"(?i)^\s*RUN\s+.*curl\s+.*\|\s*sh", (("run",), ("curl",), ("sh",)),
          "A downloaded script runs before anybody could check it.",
          "Download, verify a checksum, then run the script."),
    _rule("CMP1", "compose", "CRITICAL", "CWE-250", "Privileged container in docker-compose",
          r"(?i)privileged\s*:\s*true", ((":",), ("privileged",),),
          "A privileged service can reach every device of the host.",
          "Remove the switch and add the single capabilities that are needed."),
    _rule("CMP2", "compose", "HIGH", "CWE-668", "Host network mode in docker-compose",
          r"""(?i)network_mode\s*:\s*['"]?host['"]?""", ((":",), ("network_mode",), ("host",)),
          "The service shares the network of the host without isolation.",
          "Attach the service to a bridge or overlay network."),
    _rule("CMP3", "compose", "HIGH", "CWE-668", "Host PID namespace in docker-compose",
          r"""(?i)pid\s*:\s*['"]?host['"]?""", ((":",), ("pid",), ("host",)),
          "The service sees and may signal the processes of the host.",
          "Remove the pid setting."),
    _rule("TFM1", "terraform", "HIGH", "CWE-284", "Security group open to 0.0.0.0/0",
          r"""cidr_blocks\s*=\s*\[?\s*"0\.0\.0\.0/0"\s*\]?""", (("=",), ("cidr_blocks",), ("0.0.0.0/0",)),
          "The rule admits every address on the internet.",
          "List the address ranges that need access."),
    _rule("TFM2", "terraform", "CRITICAL", "CWE-284", "Public S3 bucket ACL",
          r"""(?i)acl\s*=\s*"public-read\"""", (("=",), ("acl",), ("public-read",)),
          "Everyone may read the objects of the bucket.",
          "Make the bucket private and grant access by policy."),
    _rule("TFM3", "terraform", "HIGH", "CWE-311", "Encryption disabled in Terraform resource",
          r"(?i)encrypted\s*=\s*false", (("=",), ("encrypted",),),
          "Data of the resource is stored in clear.",
          "Turn encryption on and name a managed key."),
    _rule("TFM4", "terraform", "HIGH", "CWE-284", "Database publicly accessible",
          r"(?i)publicly_accessible\s*=\s*true", (("=",), ("publicly_accessible",),),
          "The database accepts connections from the internet.",
          "Keep it in a private subnet and connect through a gateway."),
    _rule("K8S1", "k8s", "CRITICAL", "CWE-250", "Privileged container in Kubernetes",
          r"(?i)privileged\s*:\s*true", ((":",), ("privileged",),),
          "A privileged pod can take over its node.",
          "Set privileged to false and add single capabilities."),
    _rule("K8S2", "k8s", "HIGH", "CWE-250", "Container running as root (UID 0) in Kubernetes",
          r"runAsUser\s*:\s*0\b", ((":",), ("runasuser",),),
          "The process runs as the superuser inside its container.",
          "Choose another user id and require runAsNonRoot."),
    _rule("K8S3", "k8s", "HIGH", "CWE-668", "Host network enabled in Kubernetes pod",
          r"(?i)hostNetwork\s*:\s*true", ((":",), ("hostnetwork",),),
          "The pod shares the network of its node.",
          "Use the pod network and a service instead."),
    _rule("K8S4", "k8s", "HIGH", "CWE-668", "Host PID namespace in Kubernetes pod",
          r"(?i)hostPID\s*:\s*true", ((":",), ("hostpid",),),
          "The pod sees the processes of its node.",
          "Leave the setting out."),
    _rule("K8S5", "k8s", "HIGH", "CWE-250", "Privilege escalation allowed in Kubernetes",
          r"(?i)allowPrivilegeEscalation\s*:\s*true", ((":",), ("allowprivilegeescalation",),),
          "A process may gain more rights than its parent has.",
          "Forbid escalation in the security context."),
    _rule("K8S6", "k8s", "MEDIUM", "CWE-732", "Writable root filesystem in Kubernetes container",
          r"(?i)readOnlyRootFilesystem\s*:\s*false", ((":",), ("readonlyrootfilesystem",),),
          "An intruder can change the programs inside the container.",
          "Mount the root read-only and give scratch space as a volume."),
]
