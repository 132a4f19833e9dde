"""Names and fixed values of the metered platform; all of them are parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Naming:
    """How a platform names tenants: set ``word`` and ``label_domain`` to your platform's to get its ids,
    metric codes, property names and node labels."""

    word: str = "tenant"
    title: str = "Tenant"
    label_domain: str = "tenancy.example.com"

    @property
    def short_prefixes(self) -> tuple[str, str]:
        return f"{self.word}-", "vc-"

    def code(self, metric: str) -> str:
        return f"{self.word}_{metric}"


DEFAULT_NAMING = Naming()

# Node labels that carry a GPU model, by priority, for pods and for dedicated nodes.
POD_GPU_LABELS = (
    "nvidia.com/gpu.product",
    "nvidia.com/gpu.machine",
    "accelerator",
    "cloud.google.com/gke-accelerator",
    "k8s.amazonaws.com/accelerator",
    "node.kubernetes.io/instance-type",
)
NODE_GPU_LABELS = (
    "nvidia.com/gpu.product",
    "nvidia.com/gpu.machine",
    "cloud.google.com/gke-accelerator",
    "k8s.amazonaws.com/accelerator",
)
# Node labels and values that mark interruptible capacity; pods also look at the last one.
SPOT_LABELS = (
    "kubernetes.io/lifecycle",
    "node.kubernetes.io/lifecycle",
    "cloud.google.com/gke-preemptible",
    "cloud.google.com/gke-spot",
    "eks.amazonaws.com/capacityType",
    "karpenter.sh/capacity-type",
)
POD_SPOT_LABELS = (*SPOT_LABELS, "node.kubernetes.io/instance-type")
SPOT_VALUES = ("spot", "preemptible", "SPOT", "true")

# Metric, summed field, name, whether the spot multiplier applies.
METRICS = (
    ("cpu_core_hours", "cpu_core_hours", "CPU Core-Hours", True),
    ("memory_gb_hours", "memory_gb_hours", "Memory GB-Hours", True),
    ("storage_gb_hours", "storage_gb_hours", "Storage GB-Hours", False),
    ("instance_hours", "instance_hours", "Instance Hours", False),
    ("gpu_hours", "gpu_hours", "GPU Hours", False),
    ("gpu_utilization", "gpu_util_score", "GPU Utilization", False),
    ("network_egress_gb", "egress_gb", "Network Egress GB", False),
    ("lb_hours", "lb_hours", "LoadBalancer Hours", False),
    ("private_node_hours", "private_node_hours", "Private Node Hours", False),
)
# Unit prices by book, in the order of METRICS; None where a book names no price.
PRICE_BOOKS = {
    "default": ("0.05", "0.01", "0.001", "0.10", "2.50", "0.00", "0.05", "0.025", "1.00"),
    "neocloud": ("0.08", "0.015", "0.002", "0.25", "3.50", None, "0.08", "0.05", "2.00"),
    "internal": ("0.02", "0.005", "0.0005", "0.05", "1.00", None, "0.01", "0.01", "0.50"),
    "readme": ("0.065", "0.009", "0.0002", None, None, None, "0.09", None, "25.00"),
    "zero": ("0", "0", "0", "0", "0", "0", "0", "0", "0"),
}
GPU_PRICES = "NVIDIA-A100-SXM4-80GB:3.50,NVIDIA-H100-80GB-HBM3:5.00,NVIDIA-H100-SXM5-80GB:5.50,NVIDIA-L40S:1.80,NVIDIA-A10G:1.20,NVIDIA-T4:0.75"
BOOK_GPU_PRICES = {"default": GPU_PRICES, "neocloud": "H100:5.50", "readme": "H100:4.50"}
SPOT_DISCOUNT_PERCENT = 60.0
COLLECTION_SECONDS, RECONCILE_SECONDS, RATE_WINDOW_SECONDS = 60, 30, 300
EVENT_BATCH = 100
PRIVATE_MODE = "private_node"
